"""Toxicity scores behind a noisy-channel decoder of disguised words.

A character trigram model is counted over all documents. Places that look
disguised - letters mixed with digits or signs that stand for letters, letters
drawn out or all doubled, single letters and signs set apart, short pieces
joined by signs - become lattices: for every character the
letters it may stand for, one or two of a drawn-out letter, a separator kept or
dropped, each with its channel probability. Viterbi decoding under the
character model restores the likeliest spelling.

A lexicon is learned from labelled documents (a bounded sample,
``SAMPLE_ROWS`` of each label at most about): for every word and every word
beginning of 4 and 5 bytes, restored words included, the documents of either
label that hold it. What speaks for label 1 keeps its log odds. A document is
scored by its strongest words and their number through a logistic regression,
fitted on a part of the sample that the lexicon has not seen.

Defined cases: null or empty text has no words and the score of a text without
evidence; with labels of one kind only, or none, every score is that label's
(0 without labels); repeated labels of a document count once, the larger
holds; repeated rows get equal answers; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.llm.common import mix, span_hashes, stored, text_blocks, word_hashes
from revscope.session import table_path

#: Labelled documents of each label that the lexicon and the regression are fitted on, about.
SAMPLE_ROWS = 10_000
#: Documents of label 1 that must hold a lexicon word; lexicon words kept, the strongest.
MIN_DOCS, LEXICON_WORDS = 4, 50_000
PREFIX_BYTES = (4, 5, 6)
#: Characters the model knows: space, a to z and what Latin-1 and Latin Extended-A have as small letters.
ALPHABET = " " + "".join(c for c in map(chr, range(97, 0x180)) if c.isalpha() and c == c.lower())
_N = len(ALPHABET) + 1  # and one for all others
#: Letters that signs and digits stand for, likeliest first (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "¡": "i"}
_SEPARATORS = " .-_*~,"
_KEEP, _SUBSTITUTE, _NOISE = log(0.95), log(0.45), log(0.02)
_ONE = r"[^\W_]|[@$!|+(€£¢¡]"
_SET_APART = rf"(?<![^\W_])(?:{_ONE})(?:[ .\-_*~](?:{_ONE})){{2,}}(?![^\W_])"  # single letters and signs
_DOUBLED = r"(?<![^\W_])(?:(?P<twice>[^\W\d_])(?P=twice)){3,}(?![^\W_])"  # every letter twice
_PIECES = r"(?<![^\W_])[^\W\d_]{1,4}(?:[\-_*~][^\W\d_]{1,4})+(?![^\W_])"  # short pieces of a word
_DISGUISED = re.compile(
    rf"{_SET_APART}|{_DOUBLED}|{_PIECES}"
    r"|[0-9@$!|+(€£¢¡]*[^\W\d_]+(?:[.\-_*~]?[0-9@$!|+(€£¢¡]{1,3}[.\-_*~]?[^\W\d_]+)+[0-9@$|€£]*"  # signs within
    r"|[0-9@$!|€£¢¡][^\W\d_]{2,}"  # a sign before
    r"|[^\W\d_]*(?P<drawn>[^\W\d_])(?P=drawn)(?P=drawn)+[^\W\d_]*")  # drawn out
_ALL_APART, _ALL_DOUBLED = re.compile(_SET_APART), re.compile(_DOUBLED)
_SEVERAL_LETTERS = re.compile(r"[^\W\d_].*[^\W\d_]")

class CharModel:
    """Log probabilities of a character after two, interpolated from trigram counts."""

    def __init__(self, counts: np.ndarray):
        self.tri = counts.reshape(_N, _N, _N).astype(float)
        self.bi, self.pair = self.tri.sum(0), self.tri.sum(2)
        self.uni = self.bi.sum(0)
        self.memo: dict[str, float] = {}
        self.index = {c: i for i, c in enumerate(ALPHABET)}

    def logp(self, context: str, c: str) -> float:
        key = context + c
        found = self.memo.get(key)
        if found is None:
            a, b, i = (self.index.get(x, _N - 1) for x in key)
            p1 = (self.uni[i] + 1) / (self.uni.sum() + _N)
            p2 = (self.bi[b, i] + 50 * p1) / (self.bi[b].sum() + 50)
            found = self.memo[key] = log((self.tri[a, b, i] + 20 * p2) / (self.pair[a, b] + 20))
        return found


def lattice(seen: str) -> list[list[tuple[str, float]]]:
    """For every place of a disguised text the strings it may stand for, with log channel probabilities."""
    out: list[list[tuple[str, float]]] = []
    spaced, doubled = _ALL_APART.fullmatch(seen) is not None, _ALL_DOUBLED.fullmatch(seen) is not None
    seen = seen.lower()
    i = 0
    while i < len(seen):
        c = seen[i]
        j = i
        while j < len(seen) and seen[j] == c:
            j += 1
        run, i = j - i, j
        if doubled:
            # four of a letter are a double one
            out += [[(c, log(0.7)), (c * 2, log(0.25))]] * (run == 2) or [[(c * 2, log(0.6)), (c, log(0.35))]]
        elif c.isalpha():
            # a run of three or more was one letter or two; a double may be one
            out.append([(c, _KEEP)] if run == 1 else [(c * 2, _KEEP), (c, log(0.05))] if run == 2 else [(c, log(0.6)), (c * 2, log(0.35))])
        elif c in LEET:
            options = [(x * n, _SUBSTITUTE) for x in LEET[c] for n in ({1, min(run, 2)})]
            out.append([*options, ("", _NOISE)])
        elif spaced:
            out.append([("", log(0.8)), (" ", log(0.2))])
        else:
            out.append([("", log(0.6)), (" ", log(0.4))])
    return out


def decode(seen: str, model: CharModel) -> str:
    """Viterbi: the likeliest text behind a disguised one; states are the last two characters."""
    best: dict[str, tuple[float, str]] = {"  ": (0.0, "")}
    for options in lattice(seen):
        new: dict[str, tuple[float, str]] = {}
        for context, (score, text) in best.items():
            for letters, channel in options:
                s, ctx = score + channel, context
                for c in letters:
                    s += model.logp(ctx, c)
                    ctx = ctx[1] + c
                if ctx not in new or s > new[ctx][0]:
                    new[ctx] = (s, text + letters)
        best = new
    return max((s + model.logp(ctx, " "), text) for ctx, (s, text) in best.items())[1]


def _codes() -> np.ndarray:
    """Of every UTF-16 unit the place in the alphabet; white space, digits and marks are spaces."""
    table = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            at = ALPHABET.find(low) if len(low) == 1 else -1
            table[i] = at if at >= 0 else _N - 1
    return table


_TABLE: list[np.ndarray] = []


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigram counts of the characters of all documents; a bounded table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _TABLE:
            _TABLE.append(_codes())
        total = np.zeros(_N**3, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column("text")):
                apart = np.insert(data, offsets[1:-1], 32).tobytes().decode("utf-8", "replace")
                units = np.frombuffer(f" {apart} ".encode("utf-16-le", "surrogatepass"), np.uint16)
                c = _TABLE[0][units]
                c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]].astype(np.int32)  # one space at a time
                if len(c) > 2:
                    total += np.bincount((c[:-2] * _N + c[1:-1]) * _N + c[2:], minlength=_N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["gram", "n"])

    out = np.zeros(_N**3, np.int64)
    grams = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "gram int, n long")
    for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).toArrow().to_pylist():  # as many rows as the alphabet allows
        out[r["gram"]] = r["n"]
    return out


@dataclass
class Decoder:
    """Finds disguised places in blocks of text and restores them."""

    counts: np.ndarray
    model: CharModel | None = None
    memo: dict[str, bytes] = field(default_factory=dict)

    def restored(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, bytes]]:
        """(row, restored text) for every disguised place of a block."""
        self.model = self.model or CharModel(self.counts)
        out = []
        breaks = np.union1d(np.flatnonzero(data == 10) + 1, offsets)  # lines, and rows
        for line in np.unique(np.searchsorted(breaks, _suspects(data), "right") - 1):
            row = int(np.searchsorted(offsets, breaks[line], "right")) - 1
            for m in _DISGUISED.finditer(data[breaks[line]:breaks[line + 1]].tobytes().decode("utf-8", "replace")):
                seen = m.group()
                if not _SEVERAL_LETTERS.search(seen):  # a row of numbers, say
                    continue
                found = self.memo.get(seen)
                if found is None:
                    found = decode(seen, self.model).encode()
                    if len(self.memo) > 200_000:
                        self.memo.clear()
                    if len(seen) < 64:
                        self.memo[seen] = found
                out.append((row, found))
        return out

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "model": None, "memo": {}}


_IS_LETTER = np.array([i >= 0x80 or chr(i).isalpha() for i in range(256)])
_IS_SIGN = np.isin(np.arange(256), [ord(c) for c in LEET if ord(c) < 128] + [0xA3, 0xA2, 0xAC, 0xA1])
_IS_GAP = np.isin(np.arange(256), [ord(c) for c in " .-_*~"])
_IS_JOINT = np.isin(np.arange(256), [ord(c) for c in "-_*~"])


def _suspects(data: np.ndarray) -> np.ndarray:
    """Bytes in lines where something disguised may stand; the pattern decides."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    letter, sign, gap = _IS_LETTER[data], _IS_SIGN[data], _IS_GAP[data]
    drawn = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    beside = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    one = letter | sign
    single = one & ~np.r_[False, one[:-1]] & ~np.r_[one[1:], False]
    joined = letter[:-2] & _IS_JOINT[data[1:-1]] & letter[2:]
    found = [np.flatnonzero(drawn), np.flatnonzero(beside), np.flatnonzero(joined)]
    if len(data) > 4:
        found.append(np.flatnonzero(single[:-4] & gap[1:-3] & single[2:-2] & gap[3:-1] & single[4:]))
    if len(data) > 5:
        twice = letter[:-1] & (data[:-1] == data[1:])
        found.append(np.flatnonzero(twice[:-4] & twice[2:-2] & twice[4:]))
    return np.concatenate(found)


def evidence(data: np.ndarray, offsets: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word beginnings of a block of lower-cased rows: (row, feature)."""
    rows, features = [], []

    def add(data: np.ndarray, offsets: np.ndarray, row_of: np.ndarray) -> None:
        start, end, h, first = word_hashes(data, offsets)
        row = row_of[np.repeat(np.arange(len(offsets) - 1), np.diff(first))]
        rows.append(row)
        features.append(h)
        for n in PREFIX_BYTES:
            long = end - start > n
            rows.append(row[long])
            features.append(mix(span_hashes(data, start[long], start[long] + n) + np.uint64(n)))

    add(data, offsets, np.arange(len(offsets) - 1))
    restored = decoder.restored(data, offsets)
    if restored:
        more = np.frombuffer(b"".join(t for _, t in restored), np.uint8)
        add(more, np.concatenate([[0], np.cumsum([len(t) for _, t in restored])]), np.array([r for r, _ in restored]))
    return np.concatenate(rows), np.concatenate(features)


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def _lexicon(sample: DataFrame, decoder: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """Features that speak for label 1 and their log odds, sorted by feature."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                row, feature = evidence(data, offsets, decoder.value)
                order = np.lexsort((row, feature))
                row, feature = row[order], feature[order]
                once = np.r_[True, (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])] if len(row) else np.zeros(0, bool)
                row, feature = row[once], feature[once]
                keys, at = np.unique(feature, return_inverse=True)
                pos = np.bincount(at, toxic[lo:hi][row], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pos), pa.array(np.bincount(at, minlength=len(keys)) - pos)],
                                                 ["feature", "pos", "neg"])

    totals = sample.agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).first()
    n_pos, n_neg = totals.pos or 0, totals.neg or 0
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
    found = (sample.mapInArrow(count, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
             .filter(F.col("pos") >= MIN_DOCS).withColumn("odds", odds).filter("odds > 1").orderBy(F.col("odds").desc(), "feature").limit(LEXICON_WORDS))
    rows = sorted((r.feature, r.odds) for r in found.select("feature", "odds").collect())
    return np.array([f for f, _ in rows], np.int64), np.array([o for _, o in rows])


def summary(data: np.ndarray, offsets: np.ndarray, decoder: Decoder, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per row: the strongest log odds, the second (of another feature), and the logarithm of the number of finds."""
    out = np.zeros((len(offsets) - 1, 3))
    keys, odds = lexicon
    row, feature = evidence(data, offsets, decoder)
    if not len(keys) or not len(row):
        return out
    f = feature.view(np.int64)
    at = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
    hit = keys[at] == f
    row, at = row[hit], at[hit]
    order = np.lexsort((at, odds[at], row))[::-1]
    row, at = row[order], at[order]
    for r in np.unique(row):
        mine = at[np.searchsorted(-row, -r, "left"):np.searchsorted(-row, -r, "right")]
        different = mine[np.r_[True, mine[1:] != mine[:-1]]]
        out[r] = odds[different[0]], odds[different[1]] if len(different) > 1 else 0.0, np.log1p(len(mine))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    decoder: Decoder
    lexicon: tuple[np.ndarray, np.ndarray]
    weights: np.ndarray | None  # None: the same score for all
    constant: float = 0.0

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(offsets) - 1, self.constant)
        z = summary(data, offsets, self.decoder, self.lexicon) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on documents (doc_id, text) and labels (doc_id, toxic); the character model sees all documents."""
    spark = docs.sparkSession
    decoder = Decoder(count_trigrams(docs))
    known = (labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)")
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(decoder, (np.zeros(0, np.int64), np.zeros(0)), None, float(max(n, default=0)))
    part = F.when(F.col("toxic") == 1, F.lit(int(sample_rows / n[1] * (1 << 30)))).otherwise(F.lit(int(sample_rows / n[0] * (1 << 30))))
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < part)
    # about 2 * sample_rows ids, whatever the number of labels
    sample = stored(docs.select(F.col("doc_id").alias("id"), _lower(F.col("text")).alias("text")).join(F.broadcast(drawn), "id")
                    .select("id", "text", "toxic", (F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(3)) == 0).alias("second")), "sample")
    shared = spark.sparkContext.broadcast(decoder)
    lexicon = _lexicon(sample.filter("NOT second").select("text", "toxic"), shared)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                x = summary(data, offsets, shared.value, lexicon)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T] + [batch.column("toxic").slice(lo, hi - lo)], ["a", "b", "c", "toxic"])

    rows = sample.filter("second").select("text", "toxic").mapInArrow(summarise, "a double, b double, c double, toxic int").collect()
    x, y = np.array([r[:3] for r in rows]).reshape(-1, 3), np.array([r.toxic for r in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(decoder, lexicon, None, float(y.mean()) if len(y) else 0.0)
    return Model(decoder, lexicon, fit_logistic(x[np.lexsort(x.T)], y[np.lexsort(x.T)]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, score and predicted label."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                s = shared.value.scores(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                                 ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lower(F.col("text")).alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text")
    labels = spark.read.parquet(table_path(sf_dir, "labels")).filter(~held_out(F.col("doc_id")))
    return score(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
