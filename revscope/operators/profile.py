"""Corpus profiling (AGG1-AGG4, AGG9, AGG17, WIN1, WIN2, FLT2, LIM1, LIM2).

Scale notes
* Group totals (shares) are computed on the *aggregated* rows, never with a
  global window over the input.
* Percentiles use Spark's exact ``percentile`` aggregate over integer
  lengths: its buffer is a value→count map, so memory is bounded by the
  number of distinct lengths, not by the number of rows, and it merges
  partially on the map side. ``approx=True`` switches to
  ``percentile_approx`` for unbounded numeric domains.
* Duplicate detection counts 256-bit digests with map-side partial aggregation
  (a hot text collapses to one row per map task) and joins the few repeated
  digests back; AQE splits a skewed join partition.
* Seeded samples rank by ``md5(id-seed)``; the ``row_number() <= n`` filter
  is planned as a WindowGroupLimit, so each map task ships at most n rows
  per group into the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revscope.constants import DEFAULT_SEED
from revscope.functions.text import is_empty_text

PERCENTILES = (0.5, 0.9, 0.95, 0.99)
PERCENTILE_NAMES = ("p50", "p90", "p95", "p99")


def class_distribution(df: DataFrame, label_col: str = "label_text") -> DataFrame:
    """AGG1 + WIN2: count per label (null is a group), share of the total; most frequent first."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))
    # the window runs over the aggregated rows only (one row per label)
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("share", F.col("count") / total).orderBy(F.desc("count"), F.asc_nulls_first(label_col))


def text_length(c) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.length(F.coalesce(col, F.lit("")))


def length_aggs(length_col: str = "length", approx: bool = False) -> list:
    """AGG2 aggregate expressions: count, mean, std, min, p50..p99, max."""
    lc = F.col(length_col)
    if approx:
        pct = F.percentile_approx(lc.cast("double"), list(PERCENTILES), 100000)
    else:
        pct = F.percentile(lc, F.array(*[F.lit(p) for p in PERCENTILES]))
    return [
        F.count(lc).cast("double").alias("count"),
        F.avg(lc).alias("mean"),
        F.stddev_samp(lc).alias("std"),
        F.min(lc).cast("double").alias("min"),
        pct.alias("_pct"),
        F.max(lc).cast("double").alias("max"),
    ]


def _unpack_pct(df: DataFrame) -> DataFrame:
    cols = [c for c in df.columns if c != "_pct"]
    idx = cols.index("min") + 1
    pct_cols = [F.col("_pct")[i].cast("double").alias(n) for i, n in enumerate(PERCENTILE_NAMES)]
    return df.select(*[F.col(c) for c in cols[:idx]], *pct_cols, *[F.col(c) for c in cols[idx:]])


def text_length_summary(df: DataFrame, text_col: str = "text", by: list[str] | None = None,
                        approx: bool = False) -> DataFrame:
    """AGG2: describe() of character lengths (null counts as length 0)."""
    by = by or []
    lengths = df.select(*by, text_length(text_col).alias("length"))
    out = lengths.groupBy(*by).agg(*length_aggs("length", approx)) if by else lengths.agg(*length_aggs("length", approx))
    return _unpack_pct(out)


def empty_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """FLT2: rows whose text is null or only whitespace."""
    return df.filter(is_empty_text(text_col))


def text_digest(text_col) -> F.Column:
    """A 256-bit digest that stands for a text when texts are compared; nulls are equal."""
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.coalesce(F.sha2(c, 256), F.lit("null"))


def duplicated_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """WIN1: every row whose text occurs more than once (nulls are equal), by text.

    Digests are counted, not texts; the rows of the repeated digests are all
    that is moved."""
    repeated = df.select(text_digest(text_col).alias("_digest")).groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    rows = df.withColumn("_digest", text_digest(text_col)).join(repeated.select("_digest"), "_digest", "left_semi").drop("_digest")
    return rows.orderBy(F.asc_nulls_first(text_col))


#: Bins of the histogram that finds where a sample ends.
BINS = 1 << 16


def sample_key(id_col, seed: int = DEFAULT_SEED) -> F.Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(f"-{seed}")))


def sample_per_split(df: DataFrame, n: int | None, split_col: str = "split",
                     id_col: str = "id", seed: int = DEFAULT_SEED) -> DataFrame:
    """LIM1: at most n rows per split, seeded, deterministic; n=None → all.

    The n rows of least (md5 key, id) of each split. A histogram of the keys'
    first hex digits, ``BINS`` numbers a split, tells in which bin the n-th
    row lies; rows of lower bins are taken as they are, and only those of that
    bin are ranked, so n rows never meet in one task.
    """
    if n is None:
        return df
    key = sample_key(id_col, seed)
    digits = F.conv(F.substring(key, 1, 5), 16, 10).cast("long")
    # null ids stand before all others
    binned = df.withColumn("_bin", F.when(key.isNull(), F.lit(-1)).otherwise(F.floor(digits * BINS / (1 << 20))).cast("long"))
    before = Window.partitionBy(split_col).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    limits = (binned.groupBy(split_col, "_bin").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .filter((F.col("_before") < n)).groupBy(F.col(split_col).alias("_split"))
              .agg(F.max_by(F.struct("_bin", "_before", "_n"), "_bin").alias("_last")))
    placed = binned.join(limits, F.col(split_col).eqNullSafe(F.col("_split"))).filter(F.col("_bin") <= F.col("_last._bin"))
    edge = (F.col("_bin") == F.col("_last._bin")) & (F.col("_last._before") + F.col("_last._n") > n)
    w = Window.partitionBy(split_col).orderBy(key, F.col(id_col))
    ranked = placed.filter(edge).withColumn("_rn", F.row_number().over(w)).filter(F.col("_last._before") + F.col("_rn") <= n)
    return placed.filter(~edge).select(*df.columns).union(ranked.select(*df.columns))


def sample_examples(df: DataFrame, *, label_value=None, label_col: str = "label_text",
                    size: int = 5, id_col: str = "id", seed: int = DEFAULT_SEED) -> DataFrame:
    """LIM2 + FLT4: up to ``size`` seeded rows, optionally of one label."""
    filtered = df if label_value is None else df.filter(F.col(label_col) == F.lit(label_value))
    return filtered.orderBy(sample_key(id_col, seed), F.col(id_col)).limit(size)


def length_histogram(df: DataFrame, text_col: str = "text", bins: int = 50,
                     by: list[str] | None = None) -> DataFrame:
    """AGG17: equal-width histogram of lengths over [min, max] (non-empty bins).

    The last bin is closed on the right, like numpy's histogram.
    """
    by = by or []
    lengths = df.select(*by, text_length(text_col).alias("length"))
    bounds = lengths.groupBy(*by).agg(F.min("length").alias("_lo"), F.max("length").alias("_hi")) \
        if by else lengths.agg(F.min("length").alias("_lo"), F.max("length").alias("_hi"))
    if not by:
        # a constant key turns the scalar lookup into a 1-row broadcast hash join
        lengths, bounds, by_keys = lengths.withColumn("_g", F.lit(0)), bounds.withColumn("_g", F.lit(0)), ["_g"]
    else:
        by_keys = by
    # one row per group: bounded size, broadcast into the scan side
    joined = lengths.join(F.broadcast(bounds), by_keys, "inner")
    span = (F.col("_hi") - F.col("_lo")).cast("double")
    raw = F.floor((F.col("length") - F.col("_lo")) * F.lit(float(bins)) / span) + 1
    b = F.when(span == 0, F.lit(1)).otherwise(F.least(raw, F.lit(bins))).cast("int")
    width = span / bins
    return (joined.groupBy(*by, b.alias("bin"), "_lo", "_hi")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(*by, "bin",
                    F.bround(F.col("_lo") + (F.col("bin") - 1) * (F.col("_hi") - F.col("_lo")) / bins, 6).alias("bin_lo"),
                    F.bround(F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins, 6).alias("bin_hi"),
                    "n"))


def dataset_report(df: DataFrame, text_col: str = "text", label_col: str = "label_text",
                   split_col: str = "split") -> DataFrame:
    """AGG3/AGG4/AGG9: one row per split over already-cleaned text.

    rows, class mix ("label:count" by count desc), length summary rounded to
    2 (half-even), empty rows, rows in duplicate groups. All splits in one
    pass of grouped aggregates.
    """
    # one pass over the (cleaned) texts: what the report needs of them, counted and written once
    cells = (df.select(F.col(split_col).alias("split"), F.col(label_col).alias("label"), text_digest(text_col).alias("digest"),
                       text_length(text_col).alias("length"), is_empty_text(text_col).alias("empty"))
             .groupBy("split", "label", "digest", "length", "empty").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True))
    x, n = F.col("length").cast("double"), F.col("n")
    total, first, second = F.sum("n"), F.sum(x * n), F.sum(x * x * n)
    stats = _unpack_pct(cells.groupBy("split").agg(
        total.alias("rows"), F.coalesce(F.sum(F.when(F.col("empty"), n)), F.lit(0)).alias("empty_texts"),
        total.cast("double").alias("count"), (first / total).alias("mean"),
        F.when(total > 1, F.sqrt(F.greatest(F.lit(0.0), second - first * first / total) / (total - 1))).alias("std"),
        F.min("length").cast("double").alias("min"),
        F.percentile("length", F.array(*[F.lit(p) for p in PERCENTILES]), n).alias("_pct"),
        F.max("length").cast("double").alias("max")))
    for c in ("count", "mean", "std", "min", *PERCENTILE_NAMES, "max"):
        stats = stats.withColumn(c, F.bround(F.col(c), 2))
    stats = stats.withColumnRenamed("count", "length_count")
    dups = (cells.groupBy("split", "digest").agg(F.sum("n").alias("n"))
            .groupBy("split")
            .agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("long").alias("duplicated_texts")))
    mix = (cells.groupBy("split", "label").agg(F.sum("n").alias("n"))
           .groupBy("split")
           .agg(F.array_sort(F.collect_list(F.struct(
               (-F.col("n")).alias("neg_n"),
               F.coalesce(F.col("label").cast("string"), F.lit("null")).alias("label")))).alias("_mix"))
           .select("split", F.array_join(F.transform(
               "_mix", lambda s: F.concat(s["label"], F.lit(":"), (-s["neg_n"]).cast("string"))), ",").alias("class_distribution")))
    return stats.join(dups, "split").join(mix, "split")
