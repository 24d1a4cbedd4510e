"""What several operators share: written tables, word hashes of whole text blocks, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.session import scratch_path

#: Bytes of text that one numpy step works on; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_ASCII_WORD = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])


#: Rows of a written table of plain numbers that one task holds, about.
TASK_ROWS = 500_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (cuts the lineage).

    ``rows``, a bound on its rows, is given for tables of a few numbers a row:
    as many tasks write it as the rows fill, at least one for each core, so
    that small tables are not spread over many files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        tasks = max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
        df = df.coalesce(tasks) if tasks < shuffle_partitions(spark) else df
    # the shuffle files of this write go as soon as it is done; a chain of written tables would keep them all
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    if (tables := _TABLES.get()) is not None:
        tables.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Tables stored within the innermost ``scratch``.
_TABLES: ContextVar[list[DataFrame] | None] = ContextVar("tables", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are removed at the end, but for those that the function given was called with.

    So what leaves the block must not read the others.
    """
    kept: list[DataFrame] = []
    token = _TABLES.set([])

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        tables = _TABLES.get()
        _TABLES.reset(token)
        if (outer := _TABLES.get()) is not None:
            outer.extend(kept)
        paths = {df.stored_path for df in kept}
        discard(*[df for df in tables if df.stored_path not in paths])


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed 64-bit seeds."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(salt))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows: (first row, end row, UTF-8 bytes, row offsets).

    Null counts as empty. A run holds at most ``limit`` bytes, or one row.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in small slices, of which one at a time becomes Python strings."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as long as a block needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES)
            up, down = (np.full(size, x, np.uint64) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = _ASCII_WORD
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block: (start byte, end byte, 64-bit hash, first word of each row and the end).

    A word is a longest run of ``word_bytes`` (letters, digits and whatever
    lies beyond ASCII) within a row.
    """
    size = len(data)
    inside = word_bytes[data]
    edge = offsets[(offsets > 0) & (offsets < size)]
    before = np.empty(size, bool)
    before[:1], before[1:] = False, inside[:-1]
    before[edge] = False
    after = np.empty(size, bool)
    after[-1:], after[:-1] = False, inside[1:]
    after[edge - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, span_hashes(data, start, end), np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: differences of one running polynomial."""
    size = len(data)
    up, down = _POWERS.take(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:size], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def run_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` bytes, unmixed: ``mix`` of a hash plus ``n`` is what ``span_hashes`` has."""
    size = len(data)
    up, down = _POWERS.take(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:size], out=total[1:])
    return (total[n:] - total[:-n]) * down[:size - n + 1]


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside a row: (hash, index of the first word).

    A row of fewer words (but one at least) has one shingle, all its words.
    """
    n = len(words)
    h = words.copy()
    for j in range(1, min(k, n)):
        h[:n - j] = h[:n - j] * np.uint64(_ODD) + words[j:]
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    left = first[1:][row] - np.arange(n)
    short = np.flatnonzero((count > 0) & (count < k))
    for r in short:
        x = words[first[r]:first[r] + 1]
        for j in range(first[r] + 1, first[r + 1]):
            x = words[j:j + 1] + x * np.uint64(_ODD)
        h[first[r]] = x[0]
    keep = left >= k
    keep[first[:-1][short]] = True
    at = np.flatnonzero(keep)
    return mix(h[at]), at


def possible(df: DataFrame, key: str, wanted: DataFrame, bits: int = 1 << 24, held: bool = True) -> DataFrame:
    """Rows whose ``key`` may be among the ``key`` values of ``wanted``: all that are, and few others.

    The wanted keys set bits of a bitmap of ``bits`` bits, at most 2 MB, which
    is broadcast; so rows that are not wanted need no shuffle. Where keys
    outnumber bits it lets more through, never less. ``held=False`` returns
    the other rows.
    """
    bit = F.pmod(F.xxhash64(F.lit("bit"), F.col(key)), F.lit(bits))
    bitmap = (wanted.select(bit.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits")))
    rows = df.withColumn("_bit", bit).withColumn("_bucket", F.bitmap_bucket_number("_bit")).withColumn("_place", F.bitmap_bit_position("_bit"))
    byte = "cast(conv(hex(substring(_bits, cast(_place div 8 as int) + 1, 1)), 16, 10) as int)"
    is_set = F.expr(f"(shiftright({byte}, cast(_place % 8 as int)) & 1) = 1")
    marked = rows.join(F.broadcast(bitmap), "_bucket", "left")
    return marked.filter(F.coalesce(is_set, F.lit(False)) == F.lit(held)).drop("_bit", "_bucket", "_place", "_bits")


#: Least bits of the set that stands for a node's elements, and nodes of a bucket in one tile.
SET_BITS, TILE = 1024, 256


def set_bits(h: np.ndarray, first: np.ndarray, each: int = 2) -> list[bytes]:
    """Per row its elements (hashes ``h`` from ``first`` on) as a set of bits.

    A set has ``each`` bits for each element at least, and a power of two of
    them, so that large sets can be ruled out as well as small ones.
    """
    count = np.diff(first)
    width = np.maximum(SET_BITS, 1 << np.ceil(np.log2(np.maximum(each * count, 1))).astype(np.int64))
    out: list[bytes] = [b""] * len(count)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for lo in range(0, len(rows), step := max(1, (1 << 20) // w)):
            some = rows[lo:lo + step]
            n = count[some]
            dense = np.zeros((len(some), w), bool)
            at = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            dense[np.repeat(np.arange(len(some)), n), (h[at] % np.uint64(w)).astype(np.int64)] = True
            for r, packed in zip(some.tolist(), np.packbits(dense, axis=1, bitorder="little"), strict=True):
                out[r] = packed.tobytes()
    return out


def edits_apart(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Elements that stand in one of two bags only, at most, if ``least`` of the longer sequence is left by edits of one element each.

    An edit takes one element from either side at most, and the sizes differ by what one side has more.
    """
    return 2 * ((1 - least) * np.maximum(a, b) + 1e-9).astype(np.int64) - np.abs(a - b)


def jaccard_apart(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Elements that stand in one of two sets only, at most, if their Jaccard similarity is ``least``."""
    return ((1 - least) / (1 + least) * (a + b) + 1e-9).astype(np.int64)


def _folded_sets(bits: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Words of 64 bits of each set, and for each such number all larger sets folded to it (others are empty)."""
    width = np.array([len(b) // 8 for b in bits])
    folded = {}
    for w in np.unique(width).tolist():
        folded[w] = np.zeros((len(bits), w), np.uint64)
        for i in np.flatnonzero(width >= w):
            folded[w][i] = np.bitwise_or.reduce(np.frombuffer(bits[i], np.uint64).reshape(-1, w), axis=0)
    return width, folded


def _tile_pairs(members: DataFrame, sets: DataFrame, sketches: DataFrame, least: float, apart: Callable) -> DataFrame:
    """Pairs (a, b) of nodes of one bucket and of two components, but for those whose sets rule ``least`` out.

    ``members`` has key, j (the entry's number), node, component and n, the
    nodes of the bucket; ``sets`` has node, size and bits, and elements where
    all of a set are to be compared, by their Jaccard similarity. ``apart`` says
    how many elements of two sets may differ. Buckets are cut into tiles by the
    node's hash; a row holds two tiles of a bucket. A pair comes from the first
    entry that its sketches share.
    """
    whole = "elements" in sets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi, j, rows in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "j")), batch.column("rows"), strict=True):
                tile, node, component, size, bits, sketch, *elements = rows.values.flatten()
                elements = [x.values.to_numpy(zero_copy_only=False) for x in elements[0]] if whole else []
                tile, node, component, size = (np.asarray(c).astype(np.int64) for c in (tile, node, component, size))
                sketch = np.asarray(sketch.flatten()).reshape(len(node), -1)[:, :j]
                width, folded = _folded_sets(bits.to_pylist())
                x, y = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
                for at, i in enumerate(x):
                    others = y[at + 1:] if lo == hi else y
                    others = others[component[others] != component[i]]
                    others = others[np.abs(size[others] - size[i]) <= apart(size[others], size[i], least)]
                    for w in np.unique(np.minimum(width[others], width[i])).tolist():
                        some = others[np.minimum(width[others], width[i]) == w]
                        differ = np.bitwise_count(folded[w][some] ^ folded[w][i]).sum(1).astype(np.int64)
                        some = some[differ <= apart(size[some], size[i], least)]
                        some = some[~(sketch[some] == sketch[i]).any(1)]
                        if whole:
                            common = np.array([len(np.intersect1d(elements[i], elements[k], assume_unique=True)) for k in some], np.int64)
                            some = some[common >= least * (size[some] + size[i] - common)]
                        a.append(np.maximum(node[some], node[i]))
                        b.append(np.minimum(node[some], node[i]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    tiles = F.ceil(F.col("n") / TILE).cast("int")
    columns = ["tile", "node", "component", "size", "bits", "sketch", *["elements"] * whole]
    rows = (members.join(sets.withColumn("size", F.col("size").cast("int")), "node").join(sketches, "node").withColumn("tiles", tiles)
            .withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), "node"), F.col("tiles")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))))
    pairs = (rows.groupBy("key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
             .agg(F.first("j").alias("j"), F.collect_list(F.struct(*columns)).alias("rows")))
    return pairs.select("lo", "hi", "j", "rows").mapInArrow(run, "a long, b long").distinct()


def hub_links(nodes: DataFrame, verify: Callable[[DataFrame], DataFrame], n_sketch: int, name: str, least: float, apart: Callable,
              sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Verified links (a, b) that join what all pairs of nodes (node, sketch) that share a sketch entry would.

    In a bucket (entry number, value) every node is paired with a
    representative; ``verify`` takes pairs (a, b) and returns those that hold,
    whose sets differ as ``apart`` allows at most. The first representative is
    the smallest node. In buckets that still hold several components the next
    one is the node that shares the most such buckets with the most others: of
    one original and its many copies, unlike each other, that is the original.
    So n copies of one thing cost n pairs, and such a group 2 n. Of what is
    left all pairs of two components are verified that their sets do not rule
    out; ``sets`` gives those of some nodes (node): size and bits, and elements
    if comparing these verifies a pair.
    """
    members = nodes.select("node", F.posexplode("sketch").alias("j", "value")).select(F.xxhash64("j", "value").alias("key"), "j", "node")
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other")).filter("hub != other").select("key", "hub")
    met = stored(members.join(hubs, "key"), f"{name}-met", n_sketch * nodes.count())
    rows = met.count()
    # verification is the work: its tasks are as many as the pairs fill, the few links are gathered afterwards
    found = stored(verify(met.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()).hint("rebalance"), f"{name}-links")
    for last in (False, True):
        joined = components(found, f"{name}-classes")
        state = met.select("key", "j", "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        state = stored(state, f"{name}-state", rows)
        discard(met)
        several = (state.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
                   .filter("lo != hi").select("key", "n"))
        met = stored(state.join(several, "key").select("key", "j", "node", "component", "n"), f"{name}-apart", rows)
        discard(state)
        rows = met.count()
        if not rows:
            break
        if last:
            own = stored(sets(met.select("node").distinct()), f"{name}-sets")
            pairs = stored(_tile_pairs(met, own, nodes.select("node", "sketch"), least, apart), f"{name}-pairs")
            if "elements" in own.columns:
                return found.union(pairs)
        else:
            known = met.groupBy("node").agg(F.sum("n").alias("met"))
            ranked = met.join(known, "node").groupBy("key").agg(F.max(F.struct("met", "node", "component")).alias("hub"))
            pairs = (met.join(ranked, "key").filter(F.col("component") != F.col("hub.component"))
                     .select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct())
        found = found.union(stored(verify(pairs).hint("rebalance"), f"{name}-links"))
    return found


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected links (a, b): (node, component), the smallest node.

    Alternating large-star and small-star steps; each is joins and grouped
    minima, so no group of neighbours is ever gathered. The number of rounds
    is logarithmic in the longest path.
    """
    both = lambda d: d.select("a", "b").union(d.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a != b").distinct(), name)
    rows = edges.count()  # a round never adds links
    while not _stars(edges):
        # large-star: every greater neighbour links to the smallest node around
        near = both(edges)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(near.filter("b > a").join(least, "a")
                       .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct(), name, rows)
        discard(edges)
        # small-star: a node and its smaller neighbours link to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = stored(large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                       .union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct(), name, rows)
        discard(large)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(roots.select("node", F.col("node").alias("component"))))


def _stars(edges: DataFrame) -> bool:
    """Does every node hang on one root, and every root on nothing?"""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up > 0 AND down > 0")
    return not odd.limit(1).count()
