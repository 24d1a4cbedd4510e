"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, what is not a letter becomes one space, and n-grams of 1
to 3 characters within this text are hashed to ``2**HASH_BITS`` features.
Document frequencies cover all training documents. The weights are fitted on a
bounded sample of labelled rows (``SAMPLE_ROWS`` in all, evenly over the
languages, by a hash of id and text) with follow-the-regularised-leader
(proximal, per coordinate) and elastic-net penalties, which leaves them
sparse; a fifth of the sample fits the temperature that calibrates the
probabilities. The model is a matrix of languages by features, whatever the
corpus.

Defined cases: null text, or a text without letters, is ``und`` with score 0,
as is every text where no training row has a language; null ids count as the
empty string where rows are held out; repeated rows get equal answers; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.llm.common import slices
from revscope.session import table_path

HASH_BITS, ORDERS = 15, (1, 2, 3)
#: Labelled rows that the weights are fitted on, at most about so many.
SAMPLE_ROWS = 4_000
#: Languages that a model tells, the most frequent ones; rarer labels are not learned.
MAX_LANGUAGES = 400
#: Characters of texts that one numpy step works on; a longer text is a step of its own.
BLOCK_CHARS = 1 << 19
UNKNOWN = "und"
#: Below this score a filter rejects a document: no language is likelier than all others together.
LEAST_SCORE = 0.5


@cache
def letters() -> np.ndarray:
    """For every code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_rows(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For every text the hashed n-grams, with repetitions; empty if it has no letters."""
    run: list[str] = []
    size = 0
    for t in texts:
        t = (t or "").lower()
        if run and size + len(t) > BLOCK_CHARS:
            yield from _block(run)
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield from _block(run)


def _block(texts: list[str]) -> Iterator[np.ndarray]:
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]  # of other characters only the first after a word, as a space
    ends = np.cumsum([len(t) + 1 for t in texts])
    at = np.cumsum(keep)
    c = np.where(is_letter, points, 32)[keep].astype(np.uint32)
    hashes, h = [], np.zeros(len(c), np.uint32)
    for n in ORDERS:
        # the n-gram that ends at each character
        h = np.concatenate([np.zeros(1, np.uint32), h[:-1]]) * np.uint32(0x01000193) if n > 1 else h
        h = (h ^ c) * np.uint32(0x9E3779B1)
        hashes.append((((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(32 - HASH_BITS)).astype(np.int32))
    start = 0
    seen = np.concatenate([[0], np.cumsum(c != 32)])
    for end in ends:
        # a text's characters, with the space before it and the one after its last word
        lo, hi = max(0, int(at[start]) - 1), int(at[end])
        start = end
        if seen[hi] == seen[lo]:
            yield np.zeros(0, np.int32)
        else:
            yield np.concatenate([x[lo + n - 1:hi] for n, x in zip(ORDERS, hashes, strict=True)])


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their sublinear term frequency."""
    n = np.bincount(grams, minlength=1)
    f = np.flatnonzero(n)
    return f, 1 + np.log(n[f])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # features
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, f: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[f]
        return x / max(1e-300, float(np.sqrt((x * x).sum())))

    def logits(self, f: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return self.vector(f, tf) @ self.weights[f] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for grams in ngram_rows(texts):
            if not len(grams) or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            p = softmax(self.logits(*counted(grams)) / self.temperature)
            names.append(self.languages[int(p.argmax())])
            scores.append(float(p.max()))
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int, n_features: int, alpha: float = 0.5, beta: float = 1.0,
             l1: float = 0.01, l2: float = 0.01, epochs: int = 3, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Proximal follow-the-regularised-leader over (features, values, class) rows: weights and biases."""
    z, n = np.zeros((n_features + 1, n_languages)), np.zeros((n_features + 1, n_languages))

    def weights(zf: np.ndarray, nf: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zf) <= l1, 0.0, (np.sign(zf) * l1 - zf) / ((beta + np.sqrt(nf)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, x, y = rows[i]
            f, x = np.append(f, n_features), np.append(x, 1.0)  # the last feature is the bias
            zf, nf = z[f], n[f]
            w = weights(zf, nf)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            grown = nf + g * g
            z[f] = zf + g - (np.sqrt(grown) - np.sqrt(nf)) / alpha * w
            n[f] = grown
    w = weights(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    def loss(log_t: float) -> float:
        return -float(np.log(np.maximum(1e-300, softmax(logits / np.exp(log_t))[np.arange(len(y)), y])).mean())

    lo, hi, g = np.log(0.02), np.log(50), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of every feature over all training documents, and their number."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << HASH_BITS, np.int64), 0
        for part in slices(batches):
            for grams in ngram_rows(part.column("text").to_pylist()):
                seen = np.zeros(1 << HASH_BITS, bool)
                seen[grams] = True
                df += seen
                n += 1
        f = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(f, -1), pa.int32()), pa.array(np.append(df[f], n), pa.int64())], ["f", "n"])

    out, n = np.zeros(1 << HASH_BITS, np.int64), 0
    for r in train.select("text").mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():  # one row a feature
        if r.f < 0:
            n = r.n
        else:
            out[r.f] = r.n
    return out, n


def _sample(train: DataFrame, rows: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Features of about ``rows`` training rows, as many of each language, in a fixed order."""
    train = train.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    counts = train.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGUAGES)
    most = rows // max(1, counts.count())
    part = counts.select(F.col("lang").alias("l"), (F.lit(float(max(1, most))) / F.col("count") * (1 << 30)).alias("most"))
    keys = (train.select("key", "lang").join(part, F.col("lang") == F.col("l"))
            .filter(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 30)) < F.col("most")).select("key").distinct())
    # about as many keys as sample rows, whatever the corpus
    drawn = train.join(F.broadcast(keys), "key").select("lang", "key", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fs, tfs = [], []
            for grams in ngram_rows(part.column("text").to_pylist()):
                f, tf = counted(grams) if len(grams) else (np.zeros(0, np.int64), np.zeros(0))
                fs.append(f.astype("<i4").tobytes())
                tfs.append(tf.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("key"), pa.array(fs, pa.binary()), pa.array(tfs, pa.binary())],
                                             ["lang", "key", "f", "tf"])

    found = drawn.mapInArrow(features, "lang string, key long, f binary, tf binary").collect()
    found.sort(key=lambda r: (r.key, r.lang))
    return [(r.lang, np.frombuffer(r.f, "<i4"), np.frombuffer(r.tf, "<f4").astype(float)) for r in found if len(r.f)]


def fit(train: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on documents (doc_id, text, lang); rows without a language are left out."""
    train = train.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    df, n = _frequencies(train)
    rows = _sample(train, sample_rows)
    languages = sorted({r[0] for r in rows})
    model = Model(languages, np.log((1 + n) / (1 + df)) + 1, np.zeros((1 << HASH_BITS, len(languages))), np.zeros(len(languages)))
    if len(languages) < 2:
        return model
    data = [(f, model.vector(f, tf), languages.index(lang)) for lang, f, tf in rows]
    kept = [x for i, x in enumerate(data) if i % 5] or data
    model.weights, model.bias = fit_ftrl(kept, len(languages), 1 << HASH_BITS)
    check = data[::5]
    z = np.stack([x @ model.weights[f] + model.bias for f, x, _ in check])
    model.temperature = fit_temperature(z, np.array([y for _, _, y in check]))
    return model


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            names, scores = shared.value.predict(part.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(predict, f"{schema}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is told with a score of ``least`` or more.

    Without a model (no training row has a language) only texts without letters go.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").cast("string").alias("text"))
    if not model.languages:
        return rows.filter(F.col("text").rlike(r"\p{L}")).select("doc.*")
    return identify(rows, model, ("doc",)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("doc.*")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
