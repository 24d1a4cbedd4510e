"""Shuffled, length-bucketed batches (FEA6) without sorting the table.

Rows numbered 0 to n - 1 (``dataset.global_row_ids``) get their place in an
epoch by a keyed bijection of these numbers, the swap-or-not shuffle: in every
round a key k pairs the numbers i and k - i modulo n, and a hash of key and
pair says whether the two change places. A place follows from its number alone,
so there is no global sort, reruns agree, and every epoch has keys of its own.

Batches take neighbouring places. With ``pool`` above 1 the places of ``pool``
batches are ordered by length first, so that batches hold rows of like length
and little padding; no more than ``pool * batch_size`` rows are ranked together.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revscope.operators.features import pad_batches

ROUNDS = 24


def round_keys(seed: int, epoch: int, rounds: int = ROUNDS) -> list[int]:
    """Keys below 2**60, before they are taken modulo the number of rows."""
    return [int(hashlib.md5(f"{seed}-{epoch}-{r}".encode()).hexdigest()[:15], 16) for r in range(rounds)]


def shuffled_place(number: Column, rows: int, seed: int, epoch: int, rounds: int = ROUNDS) -> Column:
    """A row's place in an epoch: a bijection of 0 .. rows - 1."""
    n = max(rows, 1)
    keys = F.array(*[F.lit(k % n).cast("long") for k in round_keys(seed, epoch, rounds)])

    def swap(i: Column, k: Column) -> Column:
        other = F.pmod(k - i, F.lit(n).cast("long"))
        pair = F.md5(F.concat_ws("-", k.cast("string"), F.greatest(i, other).cast("string")))
        return F.when(F.substring(pair, 1, 1) >= "8", other).otherwise(i)

    return F.aggregate(keys, number.cast("long"), swap)


def shuffled_batches(rows: DataFrame, batch_size: int, seed: int = 42, epoch: int = 0, pool: int = 50,
                     number_col: str = "row_id", length: Column | None = None, pad: bool = True) -> DataFrame:
    """The encoded rows (number_col, input_ids, attention_mask, ...) of an epoch with batch and place, padded to their batch's longest."""
    if batch_size < 1 or pool < 1:
        raise ValueError("batch_size and pool must be 1 or more")
    size = F.size("input_ids") if length is None else length
    placed = rows.withColumn("place", shuffled_place(F.col(number_col), rows.count(), seed, epoch))
    if pool > 1:
        # rows of one pool are put in order of length, place among equals
        ranked = Window.partitionBy("_pool").orderBy(size, "place")
        span = batch_size * pool
        placed = (placed.withColumn("_pool", F.floor(F.col("place") / span))
                  .withColumn("place", F.col("_pool") * span + F.row_number().over(ranked) - 1).drop("_pool"))
    if pad:
        return pad_batches(placed, batch_size, "place")
    return placed.withColumn("batch", F.floor(F.col("place") / batch_size).cast("long"))
