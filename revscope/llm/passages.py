"""Repeated passages across documents: paragraph MinHash banding at two scales.

A paragraph is a line of a text; within it, content-defined blocks are the
paragraphs of the small scale: a block begins where a word pair's hash is the
least within ``RADIUS`` words to either side, so that a passage is cut alike
wherever it stands. Words are runs of letters and digits.

Lines of fewer than ``K`` words go on with the line before them, so that verse
and lists are cut as prose is. Blocks hold a dozen words, where a Jaccard
similarity of 0.8 over five-word shingles leaves room for hardly any change;
they have one band, the hash of all their words, and repeat if equal.
Neighbouring repeated blocks form runs, and runs of ``MIN_WORDS`` words and
more are repeated passages. Paragraphs of ``MIN_WORDS`` words are banded by
MinHash: ``BANDS`` bands of ``ROWS`` rows find a pair of similarity 0.8 with
probability 1 - (1 - 0.8**3)**10 = 0.9992. Only those are banded that hold a
repeated block, or one of whose ``ANCHORS`` shingles of least hash another
document has: a pair of similarity 0.8 has one in common with probability
1 - 0.2**3 = 0.992. Colliding paragraphs that no other links join are verified
by their exact Jaccard similarity.

Runs and links make components, the passages. Of every repeated block the
first instance (smallest document id, first place) is kept, and of every
paragraph of a component the first; the others are removed.

Defined cases: null text counts as empty; rows with equal id and text are one
document; null ids order last; passages shorter than ``MIN_WORDS`` words are
left alone, as is what repeats within one document only; extra columns are
ignored. Blocks and paragraphs are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revscope.llm.common import components, discard, hub_links, jaccard_apart, mix, possible, scratch, seeds, set_bits, shingle_hashes, signed, slices, stored, text_blocks, word_hashes
from revscope.session import table_path

RADIUS, K, MIN_WORDS = 4, 5, 16
BANDS, ROWS, SIMILARITY = 10, 3, 0.8
_LAST = (1 << 63) - 1
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_BLOCK = "key:long,line:int,start:int,end:int,words:int"
#: Shingles of a line, each the least under a hash of its own, of which another document must have one for the line to be banded.
ANCHORS = 3


def _folded(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of words, in order."""
    size = len(h)
    odd = np.uint64(0x9E3779B97F4A7C15)
    up, down = np.full(size + 1, odd, np.uint64), np.full(size + 1, np.uint64(pow(int(odd), -1, 1 << 64)), np.uint64)
    up[0] = down[0] = 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(up)[:size])])
    return mix((total[end] - total[start]) * np.cumprod(down)[start] + (end - start).astype(np.uint64))


class _Lines:
    """Words of a block of texts with their line, row and place in code points."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.start, self.end, self.h, self.first = word_hashes(_LOWER[data], offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        feeds = np.concatenate([[0], np.cumsum(data == 10)])
        self.line = feeds[self.start] - feeds[offsets[:-1]][self.row]
        self.data, self.offsets = data, offsets
        n = len(self.h)
        self.new_line = np.ones(n, bool)
        if n:
            self.new_line[1:] = (self.line[1:] != self.line[:-1]) | (self.row[1:] != self.row[:-1])
        self.chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.spaces = np.flatnonzero(data <= 32)

    def span(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points from the white space before word ``first`` to that after word ``end - 1``, within the row."""
        row = self.row[first]
        begin = np.concatenate([[-1], self.spaces])[np.searchsorted(self.spaces, self.start[first])] + 1
        begin = np.maximum(begin, self.offsets[:-1][row])
        stop = np.concatenate([self.spaces, [len(self.data)]])[np.searchsorted(self.spaces, self.end[end - 1])]
        stop = np.minimum(stop, self.offsets[1:][row])
        base = self.chars[self.offsets[:-1][row]]
        return self.chars[begin] - base, self.chars[stop] - base

    def blocks(self) -> np.ndarray:
        """Index of the first word of every content-defined block."""
        n = len(self.h)
        lines = np.flatnonzero(self.new_line)
        # lines of fewer words go on with what stands before them
        own = np.zeros(n, bool)
        own[lines] = np.diff(np.append(lines, n)) >= K
        own[self.first[:-1][np.diff(self.first) > 0]] = True
        pair = self.h.copy()
        pair[:-1] += np.where(own[1:], np.uint64(0), self.h[1:] * np.uint64(0x9E3779B97F4A7C15))
        v = mix(pair)
        least = np.ones(n, bool)
        number = np.cumsum(own)
        for s in range(1, min(RADIUS, n - 1) + 1):
            together = number[s:] == number[:-s]
            least[s:] &= ~together | (v[s:] < v[:-s])
            least[:-s] &= ~together | (v[:-s] <= v[s:])
        # near the ends of a line a least word would leave a scrap
        at = np.arange(n)
        begins = np.flatnonzero(own)
        ends = np.append(begins[1:], n)
        inner = (at - begins[number - 1] >= K) & (ends[number - 1] - at >= K)
        return np.flatnonzero(own | (least & inner))


def _document(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit("")))


def _anchors(lines: _Lines) -> tuple[pa.StructArray, np.ndarray]:
    """Anchors (line, h) of all lines of ``MIN_WORDS`` words, and where those of each row begin and end."""
    first = np.flatnonzero(lines.new_line)
    end = np.append(first[1:], len(lines.h))
    long = end - first >= MIN_WORDS
    first, end = first[long], end[long]
    shingles = _runs(lines.h)
    row, line, found = lines.row[first], lines.line[first], []
    if len(first):
        edges = np.stack([first, end - K + 1], 1).ravel()
        for seed in seeds(ANCHORS, 9):
            h = mix((shingles ^ seed) * (seed | np.uint64(1)))
            # of the spans [first, end - K] only; reduceat also reduces what lies between them
            found.append(np.minimum.reduceat(np.append(h, np.uint64(2**64 - 1)), edges)[::2])
    h = np.stack(found, 1).ravel() if found else np.zeros(0, np.uint64)
    pairs = pa.StructArray.from_arrays([pa.array(np.repeat(line, ANCHORS), pa.int32()), pa.array(signed(h))], ["line", "h"])
    return pairs, np.searchsorted(np.repeat(row, ANCHORS), np.arange(len(lines.offsets)))


def _runs(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``K`` words from every word on, as far as they go."""
    out = h.copy()
    for j in range(1, min(K, len(h))):
        out[:len(h) - j] = out[:len(h) - j] * np.uint64(0x9E3779B97F4A7C15) + h[j:]
    return mix(out)


def block_table(docs: DataFrame) -> DataFrame:
    """Per document: doc, id and its blocks of five words and more (number, key, line, place, words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                lines = _Lines(data, offsets)
                if len(lines.h):
                    first = lines.blocks()
                    end = np.append(first[1:], len(lines.h))
                    columns = [signed(_folded(lines.h, first, end)), lines.line[first], *lines.span(first, end), end - first]
                    counts = np.searchsorted(first, lines.first)
                else:
                    columns, counts = [np.zeros(0, np.int64)] * 5, np.zeros(hi - lo + 1, np.int64)
                anchors, at = _anchors(lines)
                names = [x.split(":")[0] for x in _BLOCK.split(",")]
                kinds = [pa.int64()] + [pa.int32()] * 4
                rows = pa.StructArray.from_arrays([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds, strict=True)], names)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in ("doc", "id")] + [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), rows), pa.ListArray.from_arrays(pa.array(at, pa.int32()), anchors)],
                                                 ["doc", "id", "blocks", "anchors"])

    rows = docs.select(_document(F.col("doc_id"), F.col("text")).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc long, id long, blocks array<struct<{_BLOCK}>>, anchors array<struct<line:int,h:long>>")


def _paragraphs(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sketch and shingles of the wanted lines (doc, lines) that have ``MIN_WORDS`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("lines").to_pylist()
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                lines = _Lines(data, offsets)
                first = np.flatnonzero(lines.new_line)
                end = np.append(first[1:], len(lines.h))
                sets = [set(x) for x in asked[lo:hi]]
                take = [i for i in range(len(first)) if end[i] - first[i] >= MIN_WORDS and int(lines.line[first[i]]) in sets[lines.row[first[i]]]]
                if not take:
                    continue
                first, end = first[take], end[take]
                words = np.concatenate([lines.h[a:b] for a, b in zip(first, end, strict=True)])
                edge = np.concatenate([[0], np.cumsum(end - first)])
                shingles, at = shingle_hashes(words, edge, K)
                cut = np.searchsorted(at, edge)
                sketch = np.empty((len(first), BANDS), np.uint64)
                for band, group in enumerate(seeds(BANDS * ROWS, 5).reshape(BANDS, ROWS)):
                    value = np.full(len(first), group[0], np.uint64)
                    for seed in group:
                        h = (shingles ^ seed) * (seed | np.uint64(1))
                        h ^= h >> np.uint64(32)
                        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h, cut[:-1]))
                    sketch[:, band] = value
                sets_ = [np.unique(shingles[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                begin, stop = lines.span(first, end)
                row = lines.row[first]
                longs = lambda flat, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(flat)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(pa.array(row + lo)), batch.column("id").take(pa.array(row + lo)), pa.array(signed(_folded(lines.h, first, end))),
                     pa.array(begin, pa.int32()), pa.array(stop, pa.int32()), pa.array(end - first, pa.int32()),
                     longs(sketch.ravel(), np.arange(len(first) + 1) * BANDS),
                     longs(np.concatenate(sets_), np.concatenate([[0], np.cumsum([len(x) for x in sets_])])), pa.array(set_bits(shingles, cut), pa.binary())],
                    ["doc", "id", "node", "start", "end", "words", "sketch", "shingles", "bits"])

    texts = docs.select(_document(F.col("doc_id"), F.col("text")).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
                        F.col("text").cast("string").alias("text"))
    return possible(texts, "doc", wanted).join(wanted, "doc").mapInArrow(
        run, "doc long, id long, node long, start int, end int, words int, sketch array<long>, shingles array<long>, bits binary")


_SPAN = ["kind", "passage", "doc", "id", "start", "end", "words", "kept"]


def passages(docs: DataFrame) -> DataFrame:
    """Instances of repeated passages: kind, passage (component), doc, id, start, end (code points), words, kept."""
    base = stored(block_table(docs), "blocks")
    every = base.select("doc", "id", F.posexplode("blocks").alias("i", "b")).select("doc", "id", "i", "b.*").filter(F.col("words") >= K)
    # the keys that repeat move first, by themselves; then only the blocks that have one
    several = every.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).filter("a != z").select("key")
    several = stored(several, "repeated")
    met = stored(possible(every, "key", several).join(several, "key", "left_semi").dropDuplicates(["doc", "i"]), "met")
    discard(several)
    first = met.groupBy("key").agg(F.min(F.struct("id", "doc", "start")).alias("first"))
    hits = stored(met.join(first, "key").withColumn("kept", (F.col("doc") == F.col("first.doc")) & (F.col("start") == F.col("first.start"))).drop("first"), "hits")
    discard(met)

    # runs of neighbouring hits of one document, then their parts that are kept or not
    inside = Window.partitionBy("doc").orderBy("i")
    runs = hits.withColumn("run", F.col("i") - F.row_number().over(inside)).withColumn("part", F.col("i") - F.row_number().over(Window.partitionBy("doc", "kept").orderBy("i")))
    run = Window.partitionBy("doc", "run")
    runs = stored(runs.withColumn("run_words", F.sum("words").over(run)).withColumn("head", F.min("key").over(run)).filter(F.col("run_words") >= MIN_WORDS), "runs")
    with scratch() as keep:
        named = keep(stored(components(runs.select(F.col("key").alias("a"), F.col("head").alias("b")).distinct(), "block-components"), "named-blocks"))
    spans = (runs.groupBy("doc", "id", "run", "kept", "part")
             .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").cast("int").alias("words"), F.min("head").alias("head"))
             .join(named, F.col("head") == F.col("node"), "left").withColumn("passage", F.coalesce("component", "head")).withColumn("kind", F.lit("run")).select(*_SPAN))

    # lines that may be like one of another document: they hold a repeated block or have a shingle of least hash in common
    anchors = base.select("doc", F.explode("anchors").alias("x")).select("doc", "x.*")
    met = anchors.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).filter("a != z").select("h")
    wanted = hits.select("doc", "line").union(anchors.join(met, "h", "left_semi").select("doc", "line")).groupBy("doc").agg(F.collect_set("line").alias("lines"))
    wanted = stored(wanted, "wanted-lines")
    discard(base, hits)
    # lines are cut twice: written with their shingles they would lie beside the shuffle and the table of their nodes
    lines = _paragraphs(docs, wanted)
    nodes = stored(lines.groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("shingles").alias("shingles"), F.first("bits").alias("bits")), "paragraph-nodes")
    places = stored(lines.select("doc", "id", "node", "start", "end", "words").dropDuplicates(["doc", "start"]), "places")
    discard(wanted)

    def verify(pairs: DataFrame) -> DataFrame:
        sets = nodes.select("node", "shingles")
        both = (pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b"))
        common = F.size(F.array_intersect("x", "y"))
        return both.filter(common >= SIMILARITY * (F.size("x") + F.size("y") - common)).select("a", "b")

    def sets(wanted: DataFrame) -> DataFrame:
        return nodes.join(wanted, "node", "left_semi").select("node", F.size("shingles").alias("size"), "bits", F.array_sort("shingles").alias("elements"))

    with scratch() as keep:
        joined = keep(stored(components(hub_links(nodes.select("node", "sketch"), verify, BANDS, "paragraph", SIMILARITY, jaccard_apart, sets), "paragraph-components"), "named-paragraphs"))
    discard(nodes)
    members = places.join(joined, "node")
    first = members.groupBy("component").agg(F.min(F.struct("id", "doc", "start")).alias("first"), F.min("doc").alias("a"), F.max("doc").alias("z")).filter("a != z")
    near = (members.join(first, "component").withColumn("kept", (F.col("doc") == F.col("first.doc")) & (F.col("start") == F.col("first.start")))
            .withColumn("kind", F.lit("paragraph")).withColumn("passage", F.col("component")).select(*_SPAN))
    return spans.union(near)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without its spans; what is left of a line keeps its line."""
    out, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            out.append(text[at:max(at, start)])
            at = end
    out.append(text[at:])
    lines = (" ".join(x for x in line.split(" ") if x) for line in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without removed passages; documents of which nothing is left go.

    A column n_chars, if there is one, follows the text.
    """
    with scratch() as keep:
        spans = passages(docs).filter("NOT kept").groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        spans = keep(stored(spans, "spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            spans = part.column("spans").to_pylist()
            texts = [t if s is None else _cut(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(part.column("text").to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_row"), pa.array(texts, pa.string()), pa.array([s is not None for s in spans])], ["doc_row", "text", "changed"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc_row"), F.col("text").cast("string").alias("text"),
                       _document(F.col("doc_id"), F.col("text")).alias("doc"))
    schema = f"doc_row {rows.schema['doc_row'].dataType.simpleString()}, text string, changed boolean"
    # texts that lose nothing are not moved
    touched = possible(rows, "doc", spans).join(spans, "doc", "left").select("doc_row", "text", "spans").mapInArrow(cut, schema)
    left = possible(rows, "doc", spans, held=False).select("doc_row", "text", F.lit(False).alias("changed"))
    done = touched.union(left).filter(~F.col("changed") | (F.length("text") > 0))
    out = []
    for c in docs.columns:
        value = F.col("text") if c == "text" else F.col(f"doc_row.`{c}`")
        if c == "n_chars":
            value = F.when(F.col("changed"), F.length("text").cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return done.select(*out)


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text")
    return passages(docs).select(
        F.col("passage").alias("passage_id"), F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id"), "start", (F.col("end") - F.col("start")).alias("length"),
        F.col("words").alias("n_words"), "kept", "kind")
