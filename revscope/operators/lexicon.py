"""Markers of a lexicon table in texts, without a nested-loop join (JOIN6).

A marker can stand in a text only if all its runs of ``GRAM`` characters do
(a shorter marker is one run). Of its runs each marker takes the one that
fewest texts have, and meets the texts by an equi-join on that run; ``contains``
then decides. So a marker costs as many rows as texts hold its rarest run, a
marker with a run that no text has costs nothing, and neither side is ever
broadcast by this module.

``lexicon``: marker, focus, priority. Of the markers found in a text the focus
of least priority wins, as ``functions.text.infer_focus`` decides for a fixed
list: a focus has the least priority of its markers, ties go to the smaller
name. Texts are lower-cased, markers are taken as they are.

Defined cases: null texts, and texts without a marker, have no focus; null and
empty markers are ignored; a marker without a priority comes last; repeated
markers, texts and ids change nothing (rows are numbered here); other columns
are carried along; an empty lexicon finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
_LAST = 2**31 - 1


def _runs(text: Column, n: int) -> Column:
    """All different runs of n characters."""
    size = F.length(text)
    return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(text, i, n)))).otherwise(
        F.array().cast("array<string>"))


def lexicon_matches(rows: DataFrame, lexicon: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, marker): every marker in every lower-cased text, once for each of the rows' (unique) keys."""
    text = F.lower(F.col(text_col))
    texts = rows.select(key, text.alias("_text")).filter("_text <> ''")
    grams = texts.select(key, F.explode(F.concat(*[_runs(F.col("_text"), n) for n in range(1, GRAM + 1)])).alias("gram"))
    markers = lexicon.select("marker").filter("marker <> ''").distinct()
    parts = markers.select("marker", F.explode(F.when(F.length("marker") < GRAM, F.array("marker")).otherwise(_runs(F.col("marker"), GRAM))).alias("gram"))
    wanted = parts.select("gram").distinct()
    common = grams.join(wanted, "gram", "left_semi")
    counts = common.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rated = parts.join(counts, "gram", "left").select("marker", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    anchors = rated.groupBy("marker").agg(F.min(F.struct("n", "gram")).alias("least")).filter("least.n > 0").select("marker", F.col("least.gram").alias("gram"))
    return (common.join(anchors, "gram").select(key, "marker").join(texts, key)
            .filter(F.col("_text").contains(F.col("marker"))).select(key, "marker"))


def infer_focus(rows: DataFrame, lexicon: DataFrame, text_col: str = "question", out_col: str = "focus") -> DataFrame:
    """The rows with the focus of their text, null if no marker stands in it."""
    numbered = rows.withColumn("_number", F.monotonically_increasing_id()).checkpoint(eager=True)
    usable = lexicon.filter("marker <> '' AND focus IS NOT NULL").select("marker", "focus", F.coalesce(F.col("priority").cast("int"), F.lit(_LAST)).alias("priority"))
    ranks = usable.groupBy("focus").agg(F.min("priority").alias("priority"))
    named = usable.select("marker", "focus").distinct().join(ranks, "focus")
    best = (lexicon_matches(numbered, usable, "_number", text_col).join(named, "marker")
            .groupBy("_number").agg(F.min(F.struct("priority", "focus")).alias("_best")).select("_number", F.col("_best.focus").alias(out_col)))
    return numbered.join(best, "_number", "left").select(*rows.columns, out_col)


def marker_counts(rows: DataFrame, lexicon: DataFrame, text_col: str = "question") -> DataFrame:
    """How many texts hold each marker: marker, texts (0 included)."""
    numbered = rows.withColumn("_number", F.monotonically_increasing_id()).checkpoint(eager=True)
    found = lexicon_matches(numbered, lexicon, "_number", text_col).groupBy("marker").agg(F.count(F.lit(1)).alias("texts"))
    return (lexicon.select("marker").filter("marker <> ''").distinct().join(found, "marker", "left")
            .select("marker", F.coalesce("texts", F.lit(0)).alias("texts")))
