"""TF-IDF features, token encoding and padding (FEA1-FEA6, AGG12, JOIN4, MTH3).

Documents become counted terms inside the tasks that hold their texts
(``counted_documents``: numbers for characters or words, sorted and counted a
slice of texts at a time); the vocabulary is ``(term, df, cf, idf, index)``,
weights are ``(id, term, index, weight)``.

Plan shape (one shuffle of raw text by document, one of vocabulary candidates):
* texts are hash-partitioned by ``id`` and stand in its order, so that rows of
  one id are one document; the rows of terms are never shuffled or written;
* the vocabulary adds up each slice's (term, df, cf) by ``groupBy(term)`` (a
  hot term is one row per slice), cut to ``min_df`` and then to the
  ``max_features`` most frequent terms by the histogram of their counts;
* weights are row-wise: every task gets the vocabulary, up to ``ROW_TERMS``
  terms; larger ones are joined to a long table of counts (``term_counts``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revscope.constants import (
    DEFAULT_CHAR_MAX_FEATURES,
    DEFAULT_CHAR_NGRAM_MAX,
    DEFAULT_CHAR_NGRAM_MIN,
    DEFAULT_MAX_FEATURES,
    DEFAULT_MIN_DF,
    DEFAULT_NGRAM_MAX,
)
from revscope.functions import text as tx


@dataclass(frozen=True)
class TermSpec:
    """How a text becomes terms."""

    analyzer: str = "word"  # "word" or "char_wb"
    ngram_min: int = 1
    ngram_max: int = DEFAULT_NGRAM_MAX
    min_df: int = DEFAULT_MIN_DF
    max_features: int | None = DEFAULT_MAX_FEATURES
    sublinear_tf: bool = True
    stop_words: tuple[str, ...] = ()
    token: str = "word"  # "word" (STR4) or "key" (STR5)

    def terms(self, text_col) -> F.Column:
        if self.analyzer == "char_wb":
            return tx.char_wb_ngrams(text_col, self.ngram_min, self.ngram_max)
        toks = tx.word_tokens(text_col) if self.token == "word" else tx.keyphrase_tokens(text_col)
        if self.stop_words:
            toks = tx.remove_stop_words(toks, self.stop_words)
        return tx.word_ngrams(toks, self.ngram_min, self.ngram_max)

    def units(self, text_col) -> F.Column:
        """What tasks make terms of: the words, or the lower-cased text with a space on either side of each word."""
        if self.analyzer == "char_wb":
            return tx.padded_words(text_col)
        toks = tx.word_tokens(text_col) if self.token == "word" else tx.keyphrase_tokens(text_col)
        return tx.remove_stop_words(toks, self.stop_words) if self.stop_words else toks


WORD_SPEC = TermSpec()
CHAR_SPEC = TermSpec(analyzer="char_wb", ngram_min=DEFAULT_CHAR_NGRAM_MIN,
                     ngram_max=DEFAULT_CHAR_NGRAM_MAX, max_features=DEFAULT_CHAR_MAX_FEATURES)


#: Documents whose terms one task counts at most, about.
TASK_DOCS = 2048
#: Vocabularies of at most so many terms are sent to all tasks; larger ones are joined.
ROW_TERMS = 1_000_000
#: Bytes of text, or words, whose terms are counted at one time.
SLICE_BYTES, SLICE_WORDS = 1 << 20, 1 << 18


def by_document(docs: DataFrame, id_col: str = "id", partitions: int | None = None) -> DataFrame:
    """Hash-partition the compact (id, text) rows by document once.

    The engine sizes partitions by their texts, but a task holds the terms of
    its texts, many times as large: with many documents there are as many
    partitions as keep a task at ``TASK_DOCS``, however few shuffles have."""
    if not partitions:
        needed = -(-docs.count() // TASK_DOCS)
        partitions = needed if needed > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    return docs.repartition(partitions, id_col) if partitions else docs.repartition(id_col)


def term_counts(docs: DataFrame, spec: TermSpec, id_col: str = "id", text_col: str = "text",
                group_cols: tuple[str, ...] = ()) -> DataFrame:
    """(group..., id, term, tf): raw term counts per document."""
    exploded = docs.select(*group_cols, id_col, F.explode(spec.terms(F.col(text_col))).alias("term"))
    return exploded.groupBy(*group_cols, id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


# ---- counting inside tasks ------------------------------------------------------------

#: Of documents (from 0): document and term number (in the names) of each different term, and how often it occurs.
Counts = tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]


def count_terms(units: pa.Array, spec: TermSpec, doc: np.ndarray) -> Counts:
    """Documents, names, term numbers and counts of the terms of ``units``, whose rows belong to the documents ``doc``."""
    grams = _char_grams(units, spec) if spec.analyzer == "char_wb" else _word_grams(units, spec)
    docs, names, codes, tfs, offset = [np.zeros(0, np.int64)], [pa.array([], pa.string())], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for row, code, bound, name in grams:
        key, tf = np.unique(doc[row] * bound + code, return_counts=True)
        found, code = np.unique(key % bound, return_inverse=True)
        docs.append(key // bound)
        names.append(name(found))
        codes.append(code + offset)
        tfs.append(tf)
        offset += len(found)
    return np.concatenate(docs), pa.concat_arrays(names), np.concatenate(codes), np.concatenate(tfs)


def _char_grams(texts: pa.Array, spec: TermSpec):
    """Of each order rows, codes, their bound and the names of codes; a padded word shorter than all orders counts whole."""
    text = texts.fill_null("")
    chars = np.frombuffer("".join(parts := text.to_pylist()).encode("utf-32-le"), "<u4")
    if not len(chars):
        return
    row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    place = np.zeros(0x110000, np.int64)
    place[chars] = 1
    alphabet = np.flatnonzero(place)
    place[alphabet] = np.arange(len(alphabet))
    digit, base = place[chars], len(alphabet)
    space = chars == 32
    begins = np.append(space[:-1] & ~space[1:], False)
    word = np.cumsum(begins)
    length = np.bincount(word)
    code, bound, ranked = digit, base, False
    for n in range(1, spec.ngram_max + 1):
        if n > 1:
            if n > len(chars):
                return
            if bound > (1 << 62) // base // max(len(parts), 1):  # too many letters to be digits: prefixes by rank
                found, code = np.unique(code, return_inverse=True)
                bound, ranked = len(found), True
            code = code[:len(chars) - n + 1] * base + digit[n - 1:]
            bound *= base
        whole = word[:len(chars) - n + 1] == word[n - 1:]
        if n < spec.ngram_min:
            whole &= begins[:len(whole)] & (length[word[:len(whole)]] == n)
        at = np.flatnonzero(whole)

        def name(found, n=n, at=at, code=code, ranked=ranked):
            if ranked:
                first = np.empty(len(found), np.int64)
                first[np.searchsorted(found, code[at])] = at
                return _strings(chars[first[:, None] + np.arange(n)])
            return _strings(alphabet[found[:, None] // base ** np.arange(n - 1, -1, -1) % base])

        if len(at):
            yield row[at], code[at], bound, name


def _strings(chars: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    size = (1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)).sum(axis=1)
    data = chars.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(chars), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data))


def _word_grams(lists: pa.ListArray, spec: TermSpec):
    """Of each order rows, codes, their bound and the names of codes."""
    length = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().dictionary_encode()
    words, digit = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(length)), length)
    code, names = digit, words
    for n in range(1, spec.ngram_max + 1):
        if n > 1:
            if n > len(digit):
                return
            found, code = np.unique(code[:len(digit) - n + 1] * len(words) + digit[n - 1:], return_inverse=True)
            names = pc.binary_join_element_wise(names.take(pa.array(found // len(words))), words.take(pa.array(found % len(words))), " ")
        at = np.flatnonzero(row[:len(code)] == row[n - 1:])
        if n >= spec.ngram_min and len(at):
            yield row[at], code[at], len(names), lambda found, names=names: names.take(pa.array(found))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose units, the last column, are of a bounded size together (or a single row)."""
    units = batch.column(batch.num_columns - 1)
    text = pa.types.is_string(units.type) or pa.types.is_large_string(units.type)
    size = (pc.binary_length(units) if text else pc.list_value_length(units)).fill_null(0).to_numpy(zero_copy_only=False)
    total, a = np.cumsum(size, dtype=np.int64), 0
    while a < batch.num_rows:
        before = total[a - 1] if a else 0
        b = max(a + 1, min(a + TASK_DOCS, int(np.searchsorted(total, before + (SLICE_BYTES if text else SLICE_WORDS), "right"))))
        yield batch.slice(a, b - a)
        a = b


def counted_documents(batches: Iterator[pa.RecordBatch], spec: TermSpec) -> Iterator[tuple[pa.Array, Counts]]:
    """Ids and counted terms of documents; rows (id, units) of one id stand one after the other.

    Of a document that may go on in the next slice only its counts are held."""
    held = None
    for batch in batches:
        for part in slices(batch):
            ids = part.column(0)
            key = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate([[True], key[1:] != key[:-1]])
            counts, first = count_terms(part.column(1), spec, np.cumsum(starts) - 1), ids.take(pa.array(np.flatnonzero(starts)))
            if held is not None:
                if held[0][0].equals(first[0]):
                    counts = _with_first(counts, held[1])
                else:
                    yield held
            last = counts[0] == len(first) - 1
            if len(first) > 1:
                yield first[:-1], tuple(x if isinstance(x, pa.Array) else x[~last] for x in counts)
            held = first[-1:], _alone(counts, last)
    if held is not None:
        yield held


def _alone(counts: Counts, rows: np.ndarray) -> Counts:
    """The counts of one document by itself."""
    return np.zeros(rows.sum(), np.int64), counts[1].take(pa.array(counts[2][rows])), np.arange(rows.sum()), counts[3][rows]


def _with_first(counts: Counts, held: Counts) -> Counts:
    """The counts, those of an earlier part of their first document added."""
    both = pa.concat_arrays([counts[1], held[1]]).dictionary_encode()
    code = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bound = max(len(both.dictionary), 1)
    key, at = np.unique(np.concatenate([counts[0] * bound + code[counts[2]], code[len(counts[1]):]]), return_inverse=True)
    return key // bound, both.dictionary, key % bound, np.bincount(at, np.concatenate([counts[3], held[3]]), len(key)).astype(np.int64)


def weigh_terms(counts: Counts, n_docs: int, vocabulary: pa.Array, idf: np.ndarray, sublinear: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, vocabulary numbers and weights of the unit TF-IDF rows of counted terms, by document."""
    doc, names, code, tf = counts
    found = pc.index_in(names, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    term = found[code] if len(code) else code
    known = term >= 0
    doc, term, tf = doc[known], term[known], tf[known]
    order = np.lexsort((term, doc))
    doc, term, tf = doc[order], term[order], tf[order]
    w = (1 + np.log(tf) if sublinear else tf) * idf[term]
    return doc, term, w / np.sqrt(np.bincount(doc, w * w, n_docs))[doc]


def term_stats(docs: DataFrame, spec: TermSpec, id_col: str = "id", text_col: str = "text", apart: bool = False) -> DataFrame:
    """(term, df, cf) of documents; ``apart``: no two rows share an id, so they may lie where they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, names, code, tf) in counted_documents(batches, spec):
            if len(names):
                df, cf = np.bincount(code, minlength=len(names)), np.bincount(code, tf, len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([names, pa.array(df), pa.array(cf)], ["term", "df", "cf"])

    rows = docs if apart else in_order(docs, id_col, text_col)
    partial = rows.select(id_col, spec.units(F.col(text_col)).alias("_units")).mapInArrow(run, "term string, df long, cf long")
    return partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")


def in_order(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, text): the rows of an id one after the other in one task."""
    return by_document(docs.select(id_col, text_col), id_col).sortWithinPartitions(id_col)


def fit_vocabulary(tf: DataFrame, n_docs: int, spec: TermSpec, id_col: str = "id") -> DataFrame:
    """AGG12 + WIN7: df/cf per term, df ≥ min_df, top max_features by cf (term
    asc on ties), smooth idf ``ln((1+n)/(1+df)) + 1``, 0-based index.

    ``n_docs`` is the number of documents fitted on (including those without
    any term) — a scalar, so idf is a plain projection.
    """
    return vocabulary_of(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), n_docs, spec)


def vocabulary_of(stats: DataFrame, n_docs: int, spec: TermSpec) -> DataFrame:
    """The vocabulary of (term, df, cf). The terms that may stand in it are written once: their numbering reads them
    twice, and each time the documents would be counted."""
    enough = stats.filter(F.col("df") >= spec.min_df).checkpoint(eager=True)
    kept = frequency_index(enough, "cf", "term", spec.max_features)
    idf = F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return kept.select("term", "df", "cf", idf.alias("idf"), "index")


def tfidf_weights(tf: DataFrame, vocab: DataFrame, spec: TermSpec, id_col: str = "id",
                  group_cols: tuple[str, ...] = ()) -> DataFrame:
    """MTH3 + JOIN4: (group..., id, term, index, weight), L2-normalised per
    document over the vocabulary terms; unseen terms are ignored."""
    tfw = (F.lit(1.0) + F.log(F.col("tf"))) if spec.sublinear_tf else F.col("tf").cast("double")
    joined = tf.join(vocab.select("term", "idf", "index"), "term").withColumn("_w", tfw * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*group_cols, id_col)))
    return joined.select(*group_cols, id_col, "term", "index", (F.col("_w") / norm).alias("weight"))


def unit_rows(terms: pa.ListArray, vocabulary: pa.Array, idf: np.ndarray, sublinear: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of terms, one a row, the rows, terms (numbers) and weights of their unit TF-IDF rows; for row-wise plans."""
    flat = pc.index_in(terms.flatten(), value_set=vocabulary)
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    length = pc.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False)
    row, size = np.repeat(np.arange(len(length)), length)[known], max(len(idf), 1)
    key, tf = np.unique(row * size + flat.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
    row, term = key // size, key % size
    w = (1 + np.log(tf) if sublinear else tf) * idf[term]
    return row, term, w / np.sqrt(np.bincount(row, w * w, len(length)))[row]


def term_lists(docs: DataFrame, spec: TermSpec, text_col: str, out_col: str) -> DataFrame:
    return docs.withColumn(out_col, F.coalesce(spec.terms(F.col(text_col)), F.array().cast("array<string>")))


def doc_count(docs: DataFrame) -> int:
    return docs.count()


def fit_tfidf(train: DataFrame, spec: TermSpec, id_col: str = "id", text_col: str = "text",
              tf: DataFrame | None = None):
    """FEA1/FEA2 fit: vocabulary and idf learnt on the training documents."""
    if tf is not None:
        return fit_vocabulary(tf, doc_count(train), spec, id_col)
    return vocabulary_of(term_stats(train, spec, id_col, text_col), doc_count(train), spec)


def transform_tfidf(docs: DataFrame, vocab: DataFrame, spec: TermSpec, id_col: str = "id",
                    text_col: str = "text") -> DataFrame:
    """FEA4: apply a frozen vocabulary/idf to any documents."""
    return _transformed(in_order(docs, id_col, text_col), vocab, spec, id_col, text_col)


def _transformed(ordered: DataFrame, vocab: DataFrame, spec: TermSpec, id_col: str, text_col: str) -> DataFrame:
    terms = vocab.select("term", "idf", "index").limit(ROW_TERMS + 1).toArrow()
    if terms.num_rows > ROW_TERMS:
        return tfidf_weights(term_counts(ordered, spec, id_col, text_col), vocab, spec, id_col)
    shared = ordered.sparkSession.sparkContext.broadcast(tuple(terms.column(c).combine_chunks() for c in terms.column_names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf, index = shared.value
        for ids, counts in counted_documents(batches, spec):
            doc, term, w = weigh_terms(counts, len(ids), vocabulary, idf.to_numpy(), spec.sublinear_tf)
            term = pa.array(term)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), vocabulary.take(term), index.take(term), pa.array(w)], [id_col, "term", "index", "weight"])

    schema = T.StructType([ordered.schema[id_col], T.StructField("term", T.StringType()), T.StructField("index", vocab.schema["index"].dataType), T.StructField("weight", T.DoubleType())])
    return ordered.select(id_col, spec.units(F.col(text_col)).alias("_units")).mapInArrow(run, schema)


def tfidf(docs: DataFrame, spec: TermSpec, id_col: str = "id", text_col: str = "text",
          partitions: int | None = None) -> DataFrame:
    """Fit and transform on the same documents."""
    # the texts feed both the vocabulary and the weights: written once
    # (reliable checkpoint, keeps their order, cuts lineage)
    d = by_document(docs.select(id_col, text_col), id_col, partitions).sortWithinPartitions(id_col).checkpoint(eager=True)
    vocab = vocabulary_of(term_stats(d, spec, id_col, text_col, apart=True), doc_count(d), spec)
    return _transformed(d, vocab, spec, id_col, text_col)


# ---- FEA5 / FEA6: token ids and padding ---------------------------------------------

PAD_ID = 0
UNK_ID = 1


def fit_token_vocabulary(train: DataFrame, max_vocab: int | None = None, text_col: str = "text") -> DataFrame:
    """Frequency vocabulary of word tokens: (token, token_id) with ids from 2
    (0 = padding, 1 = unknown); count desc, token asc; all train tokens, or
    the ``max_vocab`` most frequent."""
    counts = (train.select(F.explode(tx.word_tokens(F.col(text_col))).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    ranked = frequency_index(counts, "n", "token", max_vocab)
    return ranked.select("token", (F.col("index") + 2).cast("int").alias("token_id"))


def frequency_index(terms: DataFrame, count_col: str, term_col: str, most: int | None = None) -> DataFrame:
    """Number terms from 0 by count descending, term ascending, and keep the first ``most``.

    The histogram of counts (one row per distinct count, and term initial to
    split the counts that most terms share) gives every group its first
    number; only terms of one group are ranked together, so no window holds
    the vocabulary. Groups that begin beyond ``most`` are never ranked.
    """
    grouped = terms.withColumn("_initial", F.substring(term_col, 1, 2))
    sizes = grouped.groupBy(count_col, "_initial").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(F.desc(count_col), F.asc("_initial")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if most is not None:
        starts = starts.filter(F.col("_first") < most)
    inside = Window.partitionBy(count_col, "_initial").orderBy(term_col)
    out = (grouped.join(starts, [count_col, "_initial"])
           .withColumn("index", (F.col("_first") + F.row_number().over(inside) - 1).cast("int")).drop("_first", "_initial"))
    return out if most is None else out.filter(F.col("index") < most)


def encode_tokens(docs: DataFrame, vocab: DataFrame, max_length: int, id_col: str = "id",
                  text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """FEA5: token ids (unknown → 1) of the first ``max_length`` words,
    attention mask of ones. Rows are numbered here, so each is encoded on its
    own whatever its id; the words are cut before they are looked up."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), id_col, *keep, F.slice(tx.word_tokens(F.col(text_col)), 1, max_length).alias("_words")).checkpoint(eager=True)
    pos = rows.select("_row", F.posexplode("_words").alias("pos", "token"))
    ids = pos.join(vocab, "token", "left").select("_row", F.struct("pos", F.coalesce(F.col("token_id"), F.lit(UNK_ID)).alias("tid")).alias("p"))
    grouped = ids.groupBy("_row").agg(F.array_sort(F.collect_list("p")).alias("_p"))
    found = F.coalesce(F.transform("_p", lambda s: s["tid"]), F.array().cast("array<int>"))
    out = rows.join(grouped, "_row", "left").select(id_col, *keep, found.alias("input_ids"))
    return out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def pad_batches(enc: DataFrame, batch_size: int, pos_col: str = "pos") -> DataFrame:
    """FEA6: pad every row with 0 to the longest member of its batch
    (batch = floor(pos / batch_size)); each window spans one batch."""
    b = enc.withColumn("batch", F.floor(F.col(pos_col) / batch_size).cast("long"))
    m = F.max(F.size("input_ids")).over(Window.partitionBy("batch"))
    b = b.withColumn("_pad", m - F.size("input_ids"))
    return b.select(
        "*",
    ).withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(PAD_ID), F.col("_pad")))) \
        .withColumn("attention_mask", F.concat("attention_mask", F.array_repeat(F.lit(0), F.col("_pad")))) \
        .drop("_pad")
