"""Mixing sources to target weights: Pareto order sampling of whole documents.

Each source gets a target in words: the budget is shared by weight, no source
beyond ``max_repeat`` times its own size, and what a capped source leaves is
shared again by weight. A document of a source whose target is ``f`` times its
size is taken ``floor(f)`` times for certain; the rest of the target is a
sample of fixed size (in words) without replacement. A document's inclusion
odds are those of the fraction left, ``p / (1 - p)``, times the root of the
mean size in its source over its own size (one word added to both): the words of
a source are spread over more documents, long ones are drawn less often.
Documents are ranked by the Pareto variable, the odds of their own uniform
number divided by their inclusion odds, and taken in that order until the words
are reached, to the nearest document.

The order within a source is never sorted as a whole. The ranking variable is
mapped to (0, 1) and cut into bins; per-source sums of the bins say in which
bin the source's limit lies, and only that bin's documents are ranked.

Defined cases: null or empty text has size 0 and null source is a source of
its own, the last; repeated rows are documents of their own (same number of
draws, ties are broken by the text's digest, further ties are between equal
rows); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revscope.llm.common import discard, scratch, stored
from revscope.session import table_path

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that share a bin of the ranking variable, about.
BIN_ROWS = 2_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number inside (0, 1) that depends on the key alone: 52 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """Targets of all sources (src, source_size, n): capped shares of ``share`` times all words.

    Sources take the weights in turn, in code point order, null last. One row
    a source passes through the ordering; sharing again is repeated sums.
    """
    place = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = stored(sizes.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(max_repeat))), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    budget, level, capped = float(share * total), 0.0, -1
    while True:  # a source once capped stays so: the level only rises
        full = F.col("w") * F.lit(level) >= F.col("most") if capped >= 0 else F.lit(False)
        x = rows.agg(F.count(F.when(full, 1)).alias("n"), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("given"),
                     F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)).alias("w")).first()
        if x.n == capped or not x.w:
            break
        capped, level = x.n, (budget - x.given) / x.w
    return rows.select("src", "source_size", "n", F.least("most", F.col("w") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_repeat: float = 2.0,
        seed: str = "mix") -> DataFrame:
    """Per document (doc_id, text, source): size, source_size, target and copies taken."""
    base = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("src"), n_words(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest")), "sizes")
    sizes = base.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = stored(source_targets(sizes, weights, share, max_repeat), "targets")

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    certain = F.floor(ratio).cast("long")
    p = ratio - F.floor(ratio)
    u = uniform(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("digest")))
    spread = F.sqrt((F.col("source_size") / F.col("n") + F.lit(1.0)) / (F.col("size") + F.lit(1.0)))
    odds = (F.col("u") / (1 - F.col("u"))) / ((F.col("p") / (1 - F.col("p"))) * spread)
    bins = F.lit(max(1, base.count() // BIN_ROWS))
    ranked = stored(
        base.join(targets.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("certain", certain).withColumn("p", p).withColumn("u", u)
        .withColumn("q", F.when(F.col("p") > 0, odds))
        .withColumn("wanted", F.col("target") - F.col("certain") * F.col("source_size"))
        .withColumn("bin", F.when(F.col("p") > 0, F.floor(F.col("q") / (1 + F.col("q")) * bins)))
        .drop("p", "u", "n"), "ranked")
    discard(base)

    # a bin lies before its source's limit, holds it, or lies behind
    sums = ranked.filter("q IS NOT NULL").groupBy("src", "bin", "wanted").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("src").orderBy("bin")
    state = F.when(F.col("end") < F.col("wanted"), F.lit(1)).when(F.col("before") < F.col("wanted"), F.lit(0)).otherwise(F.lit(-1))
    places = (sums.withColumn("end", F.sum("words").over(upto)).withColumn("before", F.col("end") - F.col("words"))
              .select(F.col("src").alias("s"), F.col("bin").alias("b"), "before", state.alias("state")))
    rows = ranked.join(places, F.col("src").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")), "left").drop("s", "b")
    drawn = F.coalesce((F.col("state") > 0).cast("int"), F.lit(0))
    out = ["doc_id", "src", "digest", "size", "source_size", "target"]
    at_limit = F.coalesce(F.col("state") == 0, F.lit(False))
    order = Window.partitionBy("src", "bin").orderBy("q", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    edge = (rows.filter(at_limit).withColumn("reached", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
            .select(*out, (F.col("certain") + (F.col("reached") + F.col("size") / 2 <= F.col("wanted")).cast("long")).alias("copies")))
    return rows.filter(~at_limit).select(*out, (F.col("certain") + drawn).alias("copies")).union(edge)


def _row_key(doc_id: Column, source: Column, digest: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(doc_id, F.lit("")), digest, source))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document (with all its columns) as often as it is taken.

    Rows with the same id, source and text share the draws of their kind evenly.
    """
    with scratch() as keep:
        taken = (mix(docs, **options)
                 .groupBy(_row_key(F.col("doc_id").cast("string"), F.col("src"), F.col("digest")).alias("key"))
                 .agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).filter("copies > 0"))
        taken = keep(stored(taken, "taken"))
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       _row_key(F.col("doc_id").cast("long").cast("string"), F.col("source").cast("string"), digest).alias("key"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("turn") <= F.col("copies") % F.col("n")).cast("long")
    return (rows.join(taken, "key").withColumn("turn", turn)
            .select("doc", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("doc.*"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, source AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(text, '')) AS digest FROM documents),
sizes AS (
  SELECT src, sum(size)::BIGINT AS source_size, count(*) AS n FROM base GROUP BY src),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY src ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS most FROM sizes),
level(step, lv) AS (
  SELECT 0, (SELECT 1.5::DOUBLE * sum(source_size) / sum(w) FROM weighted)
  UNION ALL
  SELECT step + 1, (SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM weighted) - coalesce(sum(CASE WHEN w * lv >= most THEN most END), 0))
                    / nullif(sum(CASE WHEN w * lv >= most THEN 0 ELSE w END), 0) FROM weighted)
  FROM level WHERE step < 100 AND lv IS NOT NULL),
top AS (SELECT max(lv) AS lv FROM level),
targets AS (
  SELECT src, source_size, n, least(most, w * lv) AS target FROM weighted, top),
ranked AS (
  SELECT doc_id, b.src, digest, size, source_size, target, sqrt((source_size / n + 1.0::DOUBLE) / (size + 1.0::DOUBLE)) AS spread,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio,
         ((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM base b JOIN targets t ON b.src IS NOT DISTINCT FROM t.src),
drawn AS (
  SELECT *, floor(ratio)::BIGINT AS certain, ratio - floor(ratio) AS p FROM ranked),
ordered AS (
  SELECT *, target - certain * source_size AS wanted,
         coalesce(sum(size) OVER (PARTITION BY src ORDER BY (u / (1 - u)) / (p / nullif(1 - p, 0) * spread), doc_id, digest
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM drawn)
SELECT doc_id, size, source_size, target,
       ((certain + CASE WHEN p > 0 AND reached + size / 2.0::DOUBLE <= wanted THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM ordered
"""
