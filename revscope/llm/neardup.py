"""Near-duplicate documents by order MinHash, candidates verified by banded alignment.

A document is its words (lower-cased runs of letters and digits) and its k-mers
are runs of five words, each labelled with its occurrence, so that repetitions
count. For each of ``SKETCHES`` hash functions the ``PICKED`` k-mers of least
hash are kept in the order in which they stand in the text; equal picks in
equal order make two documents collide, which is likely if few edits part them.
``SHORT_SKETCHES`` further functions take runs of ``SHORT_K`` words, which
scattered edits leave whole more often: with a fifth of all words replaced at
random 0.12 of these entries are equal, and 97 of 100 pairs or more
collide (tests/llm/test_neardup.py).

Equal texts are one node from the start. Every two nodes that collide are linked
if the edit similarity of their word sequences, found by banded alignment, is
0.8 or more. Pairs that other links join already are spared: in a bucket every
node is first compared with the smallest node, then, where several components
are left, with the node that meets most others, and then all pairs of two
components are compared, but for those whose bags of words rule 0.8 out (an
edit takes one word from a bag at most). So a bucket of n copies costs n
comparisons.
Links make components; a class is named by its smallest document id.

Defined cases: null text counts as empty; a text without words equals only
equal texts; a text of fewer than five words is one k-mer; nodes are 64-bit
hashes of whole texts; null ids order last (a class of null ids has a null
name); repeated rows share a class; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revscope.llm.common import components, discard, edits_apart, hub_links, mix, possible, scratch, seeds, set_bits, shingle_hashes, signed, stored, text_blocks, word_hashes
from revscope.session import table_path

K, PICKED, SKETCHES = 5, 2, 16
SHORT_K, SHORT_SKETCHES = 3, 32
ENTRIES = SKETCHES + SHORT_SKETCHES
SIMILARITY = 0.8
_LAST = (1 << 63) - 1


def labelled(shingles: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes of k-mers together with their occurrence number in their row."""
    key = mix(shingles ^ (row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]] if len(key) else np.zeros(0, bool)
    at = np.arange(len(key))
    nth = np.empty(len(key), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(shingles + nth * np.uint64(0x9E3779B97F4A7C15))


def sketches(data: np.ndarray, offsets: np.ndarray, n: int = SKETCHES, picked: int = PICKED, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Order MinHash of a block's rows: (words in each row, rows x n sketch); rows without words have zeros."""
    _, _, words, first = word_hashes(data, offsets)
    count = np.diff(first)
    out = np.zeros((len(count), n), np.uint64)
    shingles, at = shingle_hashes(words, first, k)
    start = np.searchsorted(at, first)
    rows = np.flatnonzero(np.diff(start))
    if not len(rows):
        return count, out
    begin = start[:-1][rows]
    size = np.diff(start)[rows]
    of = np.repeat(np.arange(len(rows)), size)
    base = labelled(shingles, of)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for t, seed in enumerate(seeds(n, 77)):
        h = (base ^ seed) * (seed | np.uint64(1))
        h ^= h >> np.uint64(32)
        places = np.full((len(rows), picked), len(h), np.int64)
        for j in range(picked):
            least = np.minimum.reduceat(h, begin)
            hit = np.flatnonzero(h == least[of])
            hit = hit[h[hit] != top]
            who, one = np.unique(of[hit], return_index=True)
            places[who, j] = hit[one]
            h[hit[one]] = top
        places.sort(1)  # text order
        value = np.full(len(rows), seed, np.uint64)
        padded = np.append(shingles, np.uint64(0))
        for j in range(picked):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + padded[places[:, j]])
        out[rows, t] = value
    return count, out


def entries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries by which a block's rows collide: (words in each row, rows x ``ENTRIES``)."""
    count, out = sketches(data, offsets)
    return count, np.concatenate([out, sketches(data, offsets, SHORT_SKETCHES, k=SHORT_K)[1]], 1)


def _slide(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """Length of the common run of a from i and b from j."""
    n, step = 0, 32
    while True:
        x, y = a[i + n:i + n + step], b[j + n:j + n + step]
        m = min(len(x), len(y))
        if not m:
            return n
        differ = x[:m] != y[:m]
        t = int(differ.argmax())
        if differ[t]:
            return n + t
        n += m
        step = 512


def edit_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two sequences if it is ``most`` or less, else None.

    Common ends are cut, a bound by word counts is tried, and the rest is
    aligned within a narrow band, then within the whole band of ``most``.
    """
    if abs(len(a) - len(b)) > most:
        return None
    same = _slide(a, b, 0, 0)
    a, b = a[same:], b[same:]
    same = _slide(a[::-1], b[::-1], 0, 0)
    a, b = a[:len(a) - same], b[:len(b) - same]
    longest = max(len(a), len(b))
    if not len(a) or not len(b):
        return longest if longest <= most else None
    _, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    diff = np.bincount(at[:len(a)], minlength=at.max() + 1) - np.bincount(at[len(a):], minlength=at.max() + 1)
    least = max(int(diff[diff > 0].sum()), int(-diff[diff < 0].sum()))
    if least > most:
        return None
    x, y = at[:len(a)].tolist(), at[len(a):].tolist()
    if len(x) < len(y):
        x, y = y, x
    for band in sorted({min(most, max(least, NARROW), longest - 1), min(most, longest - 1)}):
        found = _banded(x, y, band)
        if found is not None:
            return found
    return longest if longest <= most else None  # every word replaced


#: Edits that the narrow band allows for.
NARROW = 40


def _banded(x: list[int], y: list[int], most: int) -> int | None:
    """Edit distance within the diagonals -most..most, by bit-parallel columns.

    ``x`` is the longer sequence and has more than ``most`` symbols. A column
    is an integer of one bit for each cell of the band; its differences to the
    cell above and to the column before follow by a dozen integer operations
    (Myers 1999, Hyyro 2003). The cell followed runs down the lowest diagonal
    and then along the last row.
    """
    if len(x) - len(y) > most:
        return None
    width = 2 * most + 1
    ones = (1 << width) - 1
    where: dict[int, int] = {}
    for i, s in enumerate(x):
        where[s] = where.get(s, 0) | 1 << i
    up, down = ((1 << (most + 1)) - 1) << most, 0  # differences +1 and -1 down the column
    low, along = 1 << (width - 1), 1 << (width - 2) if width > 1 else 0
    score, diagonal = most, len(x) - most
    worst = most + len(y) - diagonal  # what the last row can still win back
    for j, s in enumerate(y):
        seen = where.get(s, 0)
        match = (seen >> (j - most) if j >= most else seen << (most - j)) & ones
        zero = ((((match & up) + up) & ones) ^ up) | match | down
        plus, minus = down | (ones ^ (zero | up)), zero & up
        if j < diagonal:
            if not zero & low:
                score += 1
        else:
            if plus & along:
                score += 1
            elif minus & along:
                score -= 1
            along >>= 1
        if score > worst:
            return None
        shifted = zero >> 1
        up, down = minus | (ones ^ (shifted | plus)), shifted & plus
    return score if score <= most else None


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Is 1 - edit distance / greater length at least ``least``?"""
    n = max(len(a), len(b))
    return edit_within(a, b, int((1 - least) * n + 1e-9)) is not None


def _node(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def sketched(docs: DataFrame) -> DataFrame:
    """Per document: id, node (its text), number of words and sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                n, sketch = entries(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * ENTRIES, pa.int32()), pa.array(signed(sketch.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), batch.column("node").slice(lo, hi - lo), pa.array(n, pa.int64()), lists],
                                                 ["id", "node", "n", "sketch"])

    return _rows(docs).mapInArrow(run, "id long, node long, n long, sketch array<long>")


def bags(texts: DataFrame) -> DataFrame:
    """Of texts (node, text) the bag of words, each labelled with its occurrence, as bits: node, size, bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                _, _, words, first = word_hashes(data, offsets)
                size = np.diff(first)
                own = labelled(words, np.repeat(np.arange(len(size)), size))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(set_bits(own, first, 16), pa.binary())],
                                                 ["node", "size", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node long, size long, bits binary")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes those whose texts are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            words: dict[int, np.ndarray] = {}
            for i in range(batch.num_rows):
                pair = []
                for node, text in (("a", "text_a"), ("b", "text_b")):
                    key = batch.column(node)[i].as_py()
                    if key not in words or node == "a":
                        raw = np.frombuffer(batch.column(text)[i].as_py().encode(), np.uint8)
                        found = word_hashes(raw, np.array([0, len(raw)]))[2]
                        if node == "a":
                            pair.append(found)
                            continue
                        words = {key: found}  # hubs come in runs
                    pair.append(words[key])
                keep.append(similar(*pair))
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _rows(docs: DataFrame) -> DataFrame:
    """id, node and lower-cased text of every document."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), _node(F.col("text")).alias("node"),
                       F.lower(F.col("text").cast("string")).alias("text"))


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links (a, b) between nodes (node, first_id, n, sketch) of colliding buckets."""
    nodes = nodes.filter("n > 0")
    texts: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        if not texts:  # the first pairs name all nodes that ever meet; of a node's copies one text is fetched
            wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
            wanted = stored(wanted.join(nodes.select("node", F.col("first_id").alias("id")), "node"), "wanted", nodes.count())
            texts.append(stored(possible(_rows(docs), "node", wanted).join(wanted, ["node", "id"], "left_semi").select("node", "text"), "texts"))
        return _verified(pairs, texts[0])

    return hub_links(nodes.select("node", "sketch"), verify, ENTRIES, "documents", SIMILARITY, edits_apart,
                     lambda wanted: bags(texts[0].join(wanted, "node", "left_semi")))


def classes(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): id, node, component, class_id and class_size; null ids are the largest number."""
    base = stored(sketched(docs), "sketches")
    nodes = stored(base.groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes", base.count())
    with scratch() as keep:
        joined = keep(stored(components(links(nodes, docs)), "components"))
    named = nodes.select("node", "first_id", "rows").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(named, "named", base.count())
    discard(nodes)
    sizes = named.groupBy("component").agg(F.min("first_id").alias("class_id"), F.sum("rows").alias("class_size"))
    by_node = named.select("node", "component").join(sizes, "component").select("node", "component", "class_id", "class_size")
    return base.select("id", "node").join(by_node, "node")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, one of each class: that with the smallest id, of equal ids (null ones, too) with the smallest node."""
    with scratch() as kept:
        keep = kept(stored(classes(docs).groupBy("component").agg(F.min(F.struct("id", "node")).alias("least")).select("least.*"), "least"))
    # of equal rows with equal ids one stays
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _node(F.col("text")).alias("node"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"))
    turn = F.row_number().over(Window.partitionBy("node", "id").orderBy("node"))
    return rows.join(keep, ["node", "id"]).withColumn("turn", turn).filter("turn = 1").select("doc.*")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text")
    name = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return classes(docs).select(name("id").alias("doc_id"), name("class_id").alias("class_id"), "class_size")
