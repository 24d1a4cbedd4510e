"""Packing token sequences: shallow length combinations weighted by non-negative least squares.

Every document is tokenised once. Its ids fill as many whole windows as they
can, and what is left (1 to window - 1 ids) is one piece. The histogram of
these remainders, at most ``window - 1`` numbers whatever the corpus, goes to
the driver. There all combinations of up to ``depth`` lengths that fill a
window exactly are the columns of a non-negative least squares problem; its
solution gives the repeat counts, rounded as far as the histogram reaches, and
what remains is packed greedily, again on the histogram. The plan is a table of
ranges (bounded by the number of combinations); documents find their place in
it by their rank among pieces of the same length, counted in hashed buckets so
that no length is ranked in one task.

Defined cases: null text counts as empty, an empty text has the end id alone;
repeated rows are packed as often as they occur; other columns are ignored; an
empty table gives no rows. A piece never crosses a sequence.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revscope.llm.common import span_hashes, stored, text_blocks
from revscope.session import table_path

#: Distinct words whose ids one worker remembers; beyond, it starts anew.
CACHE_WORDS = 2_000_000
#: Pieces ranked together: buckets are as many as hold about so many documents.
BUCKET_ROWS = 100_000
_MAX_RANK = 1 << 40


# Bytes between which a text may be cut without changing its ids: white space goes, and an
# ASCII letter and ASCII punctuation never share a token. The apostrophe (of 's, 't, ...) and the
# signs of the special tokens stay with the letters beside them.
_SPACE = np.isin(np.arange(256), [9, 10, 13, 32])
_LETTER = np.array([i < 128 and chr(i).isalpha() for i in range(256)])
_MARK = np.array([32 < i < 127 and not chr(i).isalnum() and chr(i) not in "'<|>" for i in range(256)])
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


class WordEncoder:
    """Ids of whole texts, through a table of the ids of their words.

    A block's words are hashed and looked up together; only words not seen
    before reach the tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._empty()

    def _empty(self) -> None:
        self.keys, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's rows one after another, and where each row's begin and end."""
        raw = data.tobytes()
        inside = ~_SPACE[data]
        cut = (_LETTER[data[:-1]] & _MARK[data[1:]]) | (_MARK[data[:-1]] & _LETTER[data[1:]])
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        new = np.ones(len(data), bool)
        new[1:] = ~inside[:-1] | cut
        new[edge] = True
        start = np.flatnonzero(inside & new)
        last = np.ones(len(data), bool)
        last[:-1] = new[1:] | ~inside[1:]
        end = np.flatnonzero(inside & last) + 1
        # letters fold as the vocabulary's normaliser does, unless special tokens may be meant
        hashes = span_hashes(data if b"<|" in raw else _LOWER[data], start, end)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == keys[at < len(self.keys)]
        if not known.all():
            if len(self.keys) + int((~known).sum()) > CACHE_WORDS:
                self._empty()
                known[:] = False
            miss = np.flatnonzero(~known)
            self._learn(keys[miss], [raw[start[i]:end[i]].decode("utf-8", "replace") for i in first[miss]])
            at = np.searchsorted(self.keys, keys)
        begin, n = self.start[at][inverse], self.length[at][inverse].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(begin - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, offsets)]

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids, counts = [], []
        for i in range(0, len(words), 4096):
            part = words[i:i + 4096]
            begin = np.concatenate([[0], np.cumsum([len(w) + 1 for w in part])])
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            where = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            ids.append(np.array(e.ids, np.uint32))
            counts.append(np.bincount(np.searchsorted(begin, where, "right") - 1, minlength=len(part)))
        found, n = np.concatenate(ids), np.concatenate(counts)
        while self.used + len(found) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(found)] = found
        begin = self.used + np.concatenate([[0], np.cumsum(n)[:-1]])
        self.used += len(found)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start = np.insert(self.keys, at, keys), np.insert(self.start, at, begin)
        self.length = np.insert(self.length, at, n.astype(np.int32))


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenised(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """Per document: doc_id, doc_tokens, and the CRC-32 of each window of its ids."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            tokens, crcs = [], []
            for _, _, data, offsets in text_blocks(batch.column("text")):
                ids, at = encoder.encode_block(data, offsets)
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                    tokens.append(len(own))
                    crcs.append([zlib.crc32(own[i:i + window]) for i in range(0, len(own), window)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                ["doc_id", "doc_tokens", "crcs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        chunks, "doc_id long, doc_tokens long, crcs array<long>")


def combinations(lengths: np.ndarray, window: int, depth: int) -> np.ndarray:
    """All non-decreasing combinations of 2 to ``depth`` (3 at most) lengths that sum to the window.

    One row each; a combination of two has a zero first.
    """
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    first = lengths[lengths <= window // 2]
    found = [np.stack([np.zeros_like(first), first, window - first], 1)[have[window - first]]]
    if depth > 2:
        for a in lengths[lengths <= window // 3]:
            b = lengths[(lengths >= a) & (lengths <= (window - a) // 2)]
            b = b[have[window - a - b]]
            found.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(found)


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients.

    ``columns``: the lengths of each combination (0: none); ``target``: the
    histogram by length. Minimises |A x - target| over x >= 0.
    """
    size = len(target)
    flat = columns.ravel()
    live = np.where(np.arange(size) > 0, 1.0, 0.0)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, columns.shape[1]), size) * live

    def back(r: np.ndarray) -> np.ndarray:
        return (r * live)[columns].sum(1)

    v = np.ones(len(columns))
    bound = 1.0
    for _ in range(20):  # the largest eigenvalue of A'A, by the power method
        v = back(forward(v))
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - target) / (1.05 * bound))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(histogram: dict[int, int], window: int, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Sequences that use up the histogram: (lengths in one sequence, number of such sequences)."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def use(parts: tuple[int, ...], most: int | None = None) -> None:
        need: dict[int, int] = defaultdict(int)
        for p in parts:
            need[p] += 1
        n = min(int(left[p]) // k for p, k in need.items())
        n = n if most is None else min(n, most)
        if n > 0:
            for p, k in need.items():
                left[p] -= n * k
            out.append((parts, n))

    lengths = np.flatnonzero(left)
    columns = combinations(lengths, window, depth)
    if len(columns):
        x = nnls(columns, left.astype(float))
        for c in np.argsort(-x, kind="stable"):
            if x[c] <= 1e-6:
                break
            use(tuple(int(p) for p in columns[c] if p), int(np.ceil(x[c] - 1e-6)))
    while left.any():  # greedily: the longest piece, then each time the longest that still fits
        spare, parts = window, []
        taken = left.copy()
        while True:
            fits = np.flatnonzero(taken[:spare + 1])
            if not len(fits):
                break
            taken[fits[-1]] -= 1
            parts.append(int(fits[-1]))
            spare -= parts[-1]
        use(tuple(parts))
    return out


def _ranges(sequences: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Where pieces go by (length, rank): sorted keys, first sequence, offset, and the number of sequences."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for parts, n in sequences:
        offset = 0
        for p in parts:
            rows.append((p * _MAX_RANK + used[p], base, offset))
            used[p] += n
            offset += p
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), base


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, depth: int = 3) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``window`` ids; one row for each piece."""
    spark = docs.sparkSession
    base = stored(tokenised(docs, vocabulary, window, end_id), "tokenised")
    buckets = max(64, base.count() // BUCKET_ROWS)
    pieces = base.select("*", F.pmod("doc_tokens", F.lit(window)).alias("r"),
                         F.floor(F.col("doc_tokens") / window).alias("whole"),
                         F.pmod(F.xxhash64("doc_id", "crcs"), F.lit(buckets)).alias("bucket"))
    counts = stored(pieces.groupBy("r", "bucket").agg(F.count("*").alias("n"), F.sum("whole").alias("wholes")), "remainders")
    per_length = {x.r: (x.n, x.wholes) for x in counts.groupBy("r").agg(F.sum("n").alias("n"), F.sum("wholes").alias("wholes")).collect()}
    keys, first, offset, sequences = _ranges(plan({r: n for r, (n, _) in per_length.items() if r}, window, depth))
    whole_from, at = {}, sequences
    for r in sorted(per_length):
        whole_from[r], at = at, at + per_length[r][1]
    starts = np.zeros(window, np.int64)
    for r, x in whole_from.items():
        starts[r] = x
    shared = spark.sparkContext.broadcast((keys, first, offset, starts))

    before = Window.partitionBy("r").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("r", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                            F.coalesce(F.sum("wholes").over(before), F.lit(0)).alias("w0"))
    inside = Window.partitionBy("r", "bucket").orderBy("doc_id", "crcs").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (pieces.withColumn("n1", F.count("*").over(inside))
              .withColumn("w1", F.coalesce(F.sum("whole").over(inside), F.lit(0)))
              .join(offsets, ["r", "bucket"])
              .select("doc_id", "doc_tokens", "crcs", "r", (F.col("n0") + F.col("n1")).alias("rank"),
                      (F.col("w0") + F.col("w1")).alias("wholes")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, offset, starts = shared.value
        for batch in batches:
            r, rank, wholes = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("r", "rank", "wholes"))
            key = r * _MAX_RANK + rank
            if len(keys):
                at = np.searchsorted(keys, key, "right") - 1
                sequence, off = first[at] + key - keys[at], offset[at]
            else:
                sequence = off = np.zeros_like(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "doc_tokens", "crcs")] + [pa.array(x, pa.int64()) for x in (sequence, off, starts[r] + wholes)],
                ["doc_id", "doc_tokens", "crcs", "last_sequence", "last_offset", "whole_sequence"])

    placed = ranked.mapInArrow(place, "doc_id long, doc_tokens long, crcs array<long>, last_sequence long, last_offset long, whole_sequence long")
    w = F.lit(window).cast("long")
    start = F.col("i").cast("long") * w
    whole = start + w <= F.col("doc_tokens")
    return placed.select("*", F.posexplode("crcs").alias("i", "ids_crc32")).select(
        "doc_id", start.alias("start"), F.least(w, F.col("doc_tokens") - start).alias("length"), "ids_crc32", "doc_tokens",
        F.when(whole, F.col("whole_sequence") + F.col("i")).otherwise(F.col("last_sequence")).alias("sequence_id"),
        F.when(whole, F.lit(0)).otherwise(F.col("last_offset")).cast("long").alias("offset"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(table_path(sf_dir, "documents")), default_vocabulary())
