"""Fill-in-middle transformation: cut ranks are found in an indexable skip list of lines.

A document is a list of units (lines with their line ends). Every link of the
skip list carries two widths: how many units and how many code points it
passes. Lane 0 has a link for each unit; the towers of the lanes above stand
where a fixed hash of the unit's number says, one in four of the lane below. A
search descends from the top lane, adds up both widths, and so reaches a cut
rank and its code point at once; the text is sliced there.

Where the two cuts fall, and which form is written, follows from a hash of seed
and document id alone, so reruns agree and no row needs another one: the whole
operator is one pass without a shuffle.

Defined cases: null text counts as empty; an empty text, or one that contains
a marker, stays plain; a null id hashes as an empty string; equal rows give
equal rows; other columns are ignored; an empty table gives no rows. One text
at a time is a Python string, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.llm.common import mix, slices
from revscope.session import table_path

MARKS = ("<P>", "<S>", "<M>")
LINES = r"[^\n]*\n|[^\n]+"


class SkipList:
    """Units in order; each link knows its width in units and in code points."""

    def __init__(self, widths: Sequence[int]):
        points = np.asarray(widths, np.int64)
        nodes = np.arange(len(points))
        #: Of each lane, bottom first: the links' widths in units and in points, and where each node stands in the lane below.
        self.lanes: list[tuple[list[int], list[int], list[int]]] = [([1] * len(points), points.tolist(), [])]
        height = mix(nodes.astype(np.uint64) + np.uint64(1))
        while len(nodes) > 4:
            towers = np.flatnonzero((nodes == 0) | (height[nodes] & np.uint64(3) == 0))  # the head stands in every lane
            height >>= np.uint64(2)
            if len(towers) == len(nodes):
                continue
            ends = np.append(nodes[towers], len(points))
            self.lanes.append((np.diff(ends).tolist(), np.add.reduceat(points, nodes[towers]).tolist(), [*towers.tolist(), len(nodes)]))
            nodes = nodes[towers]

    def seek(self, rank: int) -> tuple[int, int]:
        """(units, code points) before the unit of this rank; the whole list if there are fewer."""
        units = points = node = 0
        for unit_widths, point_widths, below in reversed(self.lanes):
            while node < len(unit_widths) and units + unit_widths[node] <= rank:
                units += unit_widths[node]
                points += point_widths[node]
                node += 1
            if below:
                node = below[node]
        return units, points


class Infill(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def fill_in_middle(text: str | None, doc_id: int | None, seed: int = 7, rate: int = 100, spm: int = 50,
                   marks: tuple[str, str, str] = MARKS, unit: str = LINES) -> Infill:
    """One document's transformation; ``rate`` and ``spm`` are percentages."""
    text = text or ""
    widths = [len(x) for x in re.findall(unit, text)]
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(widths)
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return Infill(n, "plain", None, None, text)
    units = SkipList(widths)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = units.seek(first)[1], units.seek(second)[1]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if h4 % 100 < spm:
        return Infill(n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}")
    return Infill(n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}")


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50,
              marks: tuple[str, str, str] = MARKS, unit: str = LINES) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars and the output text of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id")
            rows = [fill_in_middle(t, i, seed, rate, spm, marks, unit)
                    for i, t in zip(ids.to_pylist(), batch.column("text").to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                             ["doc_id", *Infill._fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of ``transform`` was made from."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, len(first) + 1, 2**31 - 1)
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + len(second) + 1, F.lit(2**31 - 1))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substring(rest, F.length(two) + len(m) + 1, F.lit(2**31 - 1))

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(spark.read.parquet(table_path(sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), numbers AS (
  SELECT doc_id, t, units, len(units) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS c2,
         CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4,
         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain
  FROM docs
), cut AS (
  SELECT doc_id, t, n, CASE WHEN plain THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(list_slice(units, 1, least(c1, c2)), ''), '') AS prefix,
         coalesce(array_to_string(list_slice(units, least(c1, c2) + 1, greatest(c1, c2)), ''), '') AS middle,
         coalesce(array_to_string(list_slice(units, greatest(c1, c2) + 1, n), ''), '') AS suffix
  FROM numbers
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""
