"""Alignment of two tokenizers: identical tokens by an identity map, only the rest by a shuffle.

Both vocabularies encode the same bytes, a blank and the text. Where tokens of
both end at the same byte, the text is cut into groups; the tokens of A and B
that end there together are a link. Neither vocabulary has a token in which a blank
follows something solid (checked when it is loaded), so a text is cut before
such blanks, and a piece is encoded and aligned once a worker however
often it occurs: texts are looked up piece by piece in numpy.

A group of one token of A and one of B holds the same bytes on both sides. An
array from each id of A to the id of B with the same bytes, made once from the
two vocabularies, says which B that is; so the corpus-wide counts of those
links are one vector as long as A's vocabulary, added up a task at a time. Only
links that the array does not tell (several tokens a side, or a byte token
beside an equal piece) are shuffled as pairs of ids.

What is broadcast has a bound that no data changes: vectors as long as a
vocabulary. Written rows hold each document's links as counts by id.

Defined cases: null and empty texts, and texts whose tokens of A or B do not
give back the text's bytes, have no tokens: zeros and an empty list of groups.
Repeated rows are documents of their own, null ids are kept, other columns are
ignored, an empty table gives no rows. One text at a time is a Python string,
whatever its length.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.llm.common import slices, span_hashes, stored, text_blocks
from revscope.session import table_path

#: Distinct pieces that one worker remembers; beyond, it starts anew.
CACHE_PIECES = 1_000_000
#: A pair of ids as one number: the id of A times this plus the id of B.
_SPAN = 1 << 32

_BLANK = "▁"
_ACROSS = re.compile(r"\S ")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow 255 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Two tokenizers, the bytes of their tokens and the map of equal ones."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        #: May texts be cut before a blank that follows something solid?
        self.cuts = not any(_ACROSS.search(x.decode("utf-8", "replace")) for x in self.bytes_a + self.bytes_b)
        by_bytes = {x: i for i, x in reversed(list(enumerate(self.bytes_b))) if not self.b.is_control(i) and not self.b.is_unknown(i)}
        #: For each id of A the smallest id of B with the same bytes, or -1.
        self.same = np.array([by_bytes.get(x, -1) for x in self.bytes_a], np.int64)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A of a blank and the text, ids of B of the text (which begins with a blank there)."""
        of_b = self.b.encode(texts, num_threads=1)
        for i in range(0, len(texts), 1024):
            of_a = self.a.encode_batch([" " + t for t in texts[i:i + 1024]], add_special_tokens=False)
            yield from ((e.ids, b) for e, b in zip(of_a, of_b[i:i + 1024], strict=True))

    def align(self, text: str, ids_a: list[int], ids_b: list[int]) -> tuple[bytes, list[tuple[int, int, bool]]] | None:
        """The groups as text and the links (id of A, id of B, is it told by the map); None if bytes differ."""
        whole = b" " + text.encode("utf-8", "surrogatepass")
        a, b = [self.bytes_a[i] for i in ids_a], [self.bytes_b[i] for i in ids_b]
        if b"".join(a) != whole or b"".join(b) != whole:
            return None
        ends_a, ends_b = list(accumulate(map(len, a))), list(accumulate(map(len, b)))
        groups, links = [], []
        i = j = from_a = from_b = 0
        while i < len(a) and j < len(b):
            if ends_a[i] < ends_b[j]:
                i += 1
            elif ends_a[i] > ends_b[j]:
                j += 1
            else:
                i, j = i + 1, j + 1
                groups.append(f"{','.join(map(str, ids_a[from_a:i]))}|{','.join(map(str, ids_b[from_b:j]))}")
                links.append((ids_a[i - 1], ids_b[j - 1], i - from_a == 1 == j - from_b and self.same[ids_a[i - 1]] == ids_b[j - 1]))
                from_a, from_b = i, j
        return ";".join(groups).encode(), links


@cache
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


class Pieces:
    """Aligned pieces of texts by their hash: groups as text, numbers of tokens, links of either kind."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.empty()

    def empty(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.groups: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A and of B, groups, 1 if the bytes differ
        self.told, self.told_from = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.other, self.other_from = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def find(self, raw: bytes, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces; those not seen before are aligned."""
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self.empty()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            self._learn([raw[start[i]:end[i]].decode("utf-8", "surrogatepass") for i in first[new]])
            number = np.arange(len(self.groups) - len(new), len(self.groups))
            self.keys, self.at = np.insert(self.keys, place[new], keys[new]), np.insert(self.at, place[new], number)
        return self.at[np.searchsorted(self.keys, keys)][inverse]

    def _learn(self, texts: list[str]) -> None:
        counts, told, other, told_n, other_n = [], [], [], [], []
        for text, (a, b) in zip(texts, self.pair.encode(texts), strict=True):
            groups, links = self.pair.align(text, a, b) or (None, [])
            self.groups.append(groups or b"")
            counts.append((len(a), len(b), len(links), groups is None))
            mine = [x for x, _, is_told in links if is_told]
            rest = [x * _SPAN + y for x, y, is_told in links if not is_told]
            told += mine
            other += rest
            told_n.append(len(mine))
            other_n.append(len(rest))
        self.counts = np.concatenate([self.counts, np.array(counts, np.int64)])
        self.told, self.other = np.append(self.told, np.array(told, np.int32)), np.append(self.other, np.array(other, np.int64))
        self.told_from = np.append(self.told_from, self.told_from[-1] + np.cumsum(told_n))
        self.other_from = np.append(self.other_from, self.other_from[-1] + np.cumsum(other_n))


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, end), one range after another."""
    n = end - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _cut(data: np.ndarray, offsets: np.ndarray, cuts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a block of texts: start and end byte without the blank before them, first piece of each text and the end."""
    size = len(data)
    new = np.zeros(size, bool)
    if cuts:
        # a blank after an ASCII sign, or after a letter beyond ASCII that cannot be white space
        before = np.concatenate([np.zeros(3, np.uint8), data])
        one, two, three = before[2:-1], before[1:-2], before[:-3]
        solid = (one > 32) & (one < 127) | (one >= 128) & (two != 0xC2) & ~np.isin(three, [0xE1, 0xE2, 0xE3])
        new = (data == 32) & solid
    new[offsets[:-1][np.diff(offsets) > 0]] = False
    breaks = np.flatnonzero(new)
    firsts = offsets[:-1][np.diff(offsets) > 0]
    start = np.sort(np.concatenate([firsts, breaks + 1]))  # texts stand after the blank that is put before them
    at = np.searchsorted(start, offsets[:-1])
    end = np.append(start[1:], size)
    is_first = np.isin(start, firsts)
    end[:-1] -= ~is_first[1:]
    return start, end, np.append(at, len(start))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row: doc_id, row (a number of its own), n_a, n_b, n_groups, n_links, the groups as text (``a1,a2|b1;a3|b2``) and its links.

    ``told`` and ``told_n`` are the ids of A whose link the identity map tells
    and how often they occur, ``other`` and ``other_n`` the pairs of all other
    links (id of A * 2**32 + id of B).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        pieces = Pieces(pair)
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(8)]
            for lo, hi, data, offsets in text_blocks(batch.column("text")):
                raw = data.tobytes()
                start, end, first = _cut(data, offsets, pair.cuts)
                number = pieces.find(raw, start, end, span_hashes(data, start, end)) if len(start) else np.zeros(0, np.int64)
                for t in range(hi - lo):
                    n = number[first[t]:first[t + 1]]
                    told, other = pieces.told[_ranges(pieces.told_from[n], pieces.told_from[n + 1])], pieces.other[_ranges(pieces.other_from[n], pieces.other_from[n + 1])]
                    tokens_a, tokens_b, links, differ = pieces.counts[n].sum(0).tolist()
                    groups = b""
                    if differ:  # pieces that differ may still add up; the whole text decides
                        text = raw[offsets[t]:offsets[t + 1]].decode("utf-8", "surrogatepass")
                        ((a, b),) = pair.encode([text])
                        found = pair.align(text, a, b)
                        groups, whole = found or (b"", [])
                        tokens_a, tokens_b, links = (len(a), len(b), len(whole)) if found else (0, 0, 0)
                        told = np.array([x for x, _, is_told in whole if is_told], np.int32)
                        other = np.array([x * _SPAN + y for x, y, is_told in whole if not is_told], np.int64)
                    else:
                        groups = b";".join([pieces.groups[i] for i in n.tolist()])
                    ids, times = np.unique(told, return_counts=True)
                    pairs, pair_times = np.unique(other, return_counts=True)
                    for c, x in zip(columns, (tokens_a, tokens_b, links, groups.decode(), ids, times, pairs, pair_times), strict=True):
                        c.append(x)
            n = batch.num_rows
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            a, b, links, *rest = (pa.array(c, k) for c, k in zip(columns, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.arange(row, row + n)), a, b, links, links, *rest],
                                             ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "told", "told_n", "other", "other_n"])
            row += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups string, "
             "told array<int>, told_n array<long>, other array<long>, other_n array<long>")


def _told_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Corpus-wide links of each id of A that the identity map tells: one vector a task, then their sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids = batch.column("told").flatten().to_numpy(zero_copy_only=False)
            np.add.at(total, ids, batch.column("told_n").flatten().to_numpy(zero_copy_only=False))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "n"])

    total = np.zeros(size, np.int64)
    for x in rows.select("told", "told_n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most a vocabulary
        total[x.id] = x.n
    return total


def link_counts(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``rows`` of ``aligned`` (written) with n_best and count_sum: their links by the corpus-wide counts of their pairs."""
    spark = rows.sparkSession
    pair = _pair(path_a, path_b)
    told = _told_counts(rows, len(pair.bytes_a))
    single = (rows.select("row", F.explode(F.arrays_zip("other", "other_n")).alias("x"))
              .select("row", F.col("x.other").alias("pair"), F.col("x.other_n").alias("n")))
    pairs = stored(single.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    # the highest count of each id of B, over both kinds of links: vectors as long as B's vocabulary
    best = np.zeros(len(pair.bytes_b), np.int64)
    for x in pairs.groupBy(F.pmod("pair", F.lit(_SPAN)).alias("b")).agg(F.max("count").alias("n")).collect():
        best[x.b] = x.n
    held = np.flatnonzero(pair.same >= 0)
    np.maximum.at(best, pair.same[held], told[held])
    is_best = np.zeros(len(told), bool)
    is_best[held] = told[held] == best[pair.same[held]]
    shared = spark.sparkContext.broadcast((told, is_best))
    highest = spark.createDataFrame(pa.table({"b": np.arange(len(best)), "best": best}))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, is_best = shared.value
        for batch in batches:
            ids, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("told", "told_n"))
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(batch.column("told")).to_numpy(zero_copy_only=False))
            all_counts, all_best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(all_counts, row, told[ids] * times)
            np.add.at(all_best, row, is_best[ids] * times)
            keep = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("told", "told_n")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(all_best), pa.array(all_counts)], [*(c for c in batch.schema.names if c not in ("told", "told_n")), "told_best", "told_sum"])

    plain = rows.drop("other", "other_n")
    kept = plain.drop("told", "told_n")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", told_best long, told_sum long"
    counted = (pairs.withColumn("b", F.pmod("pair", F.lit(_SPAN))).join(F.broadcast(highest), "b")
               .select("pair", "count", (F.col("count") == F.col("best")).cast("long").alias("is_best")))
    rest = (single.join(counted, "pair").groupBy("row")
            .agg(F.sum(F.col("n") * F.col("is_best")).alias("best"), F.sum(F.col("n") * F.col("count")).alias("sum")))
    zero = F.lit(0).cast("long")
    return (plain.mapInArrow(sums, schema).join(rest, "row", "left")
            .select(*kept.columns, (F.col("told_best") + F.coalesce("best", zero)).alias("n_best"), (F.col("told_sum") + F.coalesce("sum", zero)).alias("count_sum")))


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = default_vocabularies()
    found = aligned(spark.read.parquet(table_path(sf_dir, "documents")), a, b)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = stored(found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return link_counts(rows, a, b).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
