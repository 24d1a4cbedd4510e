"""Profiling and dataset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from revscope.functions.text import clean_text
from revscope.operators import dataset, profile
from revscope.plans.registry import query
from revscope.plans.sqlviews import SQL_WS, sql_clean, with_views
from revscope.sources import testdata as td


@query("load_reviews", with_views("reviews") + """
SELECT id, text, label, label_text, split FROM reviews""")
def load_reviews(spark, sf):
    return dataset.load_reviews(td.reviews(spark, sf))


@query("class_distribution", with_views("reviews") + """
SELECT label_text, count(*) AS count, count(*) / sum(count(*)) OVER () AS share
FROM reviews GROUP BY label_text""", headline=True)
def class_distribution(spark, sf):
    return profile.class_distribution(td.reviews(spark, sf), "label_text")


_LEN_SQL = """
count(*)::DOUBLE AS count, avg(length(coalesce({t}, ''))) AS mean,
stddev_samp(length(coalesce({t}, ''))) AS std, min(length(coalesce({t}, '')))::DOUBLE AS min,
quantile_cont(length(coalesce({t}, '')), 0.5) AS p50,
quantile_cont(length(coalesce({t}, '')), 0.9) AS p90,
quantile_cont(length(coalesce({t}, '')), 0.95) AS p95,
quantile_cont(length(coalesce({t}, '')), 0.99) AS p99,
max(length(coalesce({t}, '')))::DOUBLE AS max"""


@query("length_summary", with_views("all_docs") + "SELECT" + _LEN_SQL.format(t="text")
       + "\nFROM all_docs", headline=True)
def length_summary(spark, sf):
    return profile.text_length_summary(td.all_docs(spark, sf), "text")


@query("dataset_report", with_views("reviews") + f"""
, c AS (SELECT split, {sql_clean("text")} AS text, label_text AS label FROM reviews)
, stats AS (
  SELECT split, count(*) AS rows,
    count(*) FILTER (WHERE regexp_full_match(coalesce(text, ''), '{SQL_WS}*')) AS empty_texts,
    round_even(count(*)::DOUBLE, 2) AS length_count,
    round_even(avg(length(coalesce(text, ''))), 2) AS mean,
    round_even(stddev_samp(length(coalesce(text, ''))), 2) AS std,
    round_even(min(length(coalesce(text, '')))::DOUBLE, 2) AS min,
    round_even(quantile_cont(length(coalesce(text, '')), 0.5), 2) AS p50,
    round_even(quantile_cont(length(coalesce(text, '')), 0.9), 2) AS p90,
    round_even(quantile_cont(length(coalesce(text, '')), 0.95), 2) AS p95,
    round_even(quantile_cont(length(coalesce(text, '')), 0.99), 2) AS p99,
    round_even(max(length(coalesce(text, '')))::DOUBLE, 2) AS max
  FROM c GROUP BY split)
, dups AS (
  SELECT split, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicated_texts
  FROM (SELECT split, text, count(*) AS n FROM c GROUP BY split, text) GROUP BY split)
, mix AS (
  SELECT split, string_agg(coalesce(CAST(label AS VARCHAR), 'null') || ':' || CAST(n AS VARCHAR), ','
                           ORDER BY n DESC, coalesce(CAST(label AS VARCHAR), 'null')) AS class_distribution
  FROM (SELECT split, label, count(*) AS n FROM c GROUP BY split, label) GROUP BY split)
SELECT * FROM stats JOIN dups USING (split) JOIN mix USING (split)""", headline=True)
def dataset_report(spark, sf):
    r = td.reviews(spark, sf).withColumn("text", clean_text("text"))
    return profile.dataset_report(r, "text", "label_text", "split")


@query("duplicated_texts", with_views("all_docs") + """
SELECT * FROM all_docs WHERE text IN (SELECT text FROM all_docs GROUP BY text HAVING count(*) > 1)
""", headline=True)
def duplicated_texts(spark, sf):
    return profile.duplicated_texts(td.all_docs(spark, sf), "text")


@query("empty_texts", with_views("all_docs") + f"""
SELECT * FROM all_docs WHERE regexp_full_match(coalesce(text, ''), '{SQL_WS}*')""")
def empty_texts(spark, sf):
    return profile.empty_texts(td.all_docs(spark, sf), "text")


@query("sample_per_split", with_views("reviews") + """
SELECT id, text, label, label_text, split, source FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5(CAST(id AS VARCHAR) || '-42'), id) AS rn
  FROM reviews) WHERE rn <= 25""")
def sample_per_split(spark, sf):
    return profile.sample_per_split(td.reviews(spark, sf), 25)


@query("sample_examples", with_views("reviews") + """
SELECT * FROM reviews WHERE label_text = 'negative'
ORDER BY md5(CAST(id AS VARCHAR) || '-42'), id LIMIT 5""")
def sample_examples(spark, sf):
    return profile.sample_examples(td.reviews(spark, sf), label_value="negative",
                                   label_col="label_text", size=5)


@query("length_histogram", with_views("all_docs") + """
, l AS (SELECT length(coalesce(text, '')) AS length FROM all_docs)
, b AS (SELECT min(length) AS lo, max(length) AS hi FROM l)
, binned AS (
  SELECT CAST(CASE WHEN hi = lo THEN 1
              ELSE least(floor((length - lo) * 50.0 / CAST(hi - lo AS DOUBLE)) + 1, 50) END AS INTEGER) AS bin,
         lo, hi
  FROM l, b)
SELECT bin, round(lo + (bin - 1) * (hi - lo) / 50.0, 6) AS bin_lo,
       round(lo + bin * (hi - lo) / 50.0, 6) AS bin_hi, count(*) AS n
FROM binned GROUP BY bin, lo, hi""")
def length_histogram(spark, sf):
    return profile.length_histogram(td.all_docs(spark, sf), "text", bins=50)


@query("prepare_classification", with_views("reviews") + f"""
SELECT {sql_clean("text")} AS text, label FROM reviews""")
def prepare_classification(spark, sf):
    return dataset.prepare_classification(td.reviews(spark, sf), keep_label_text=False)


@query("binary_polarity", with_views("reviews") + f"""
SELECT id, split, {sql_clean("text")} AS text, CASE WHEN label = 2 THEN 1 ELSE 0 END AS label
FROM reviews WHERE label <> 1""")
def binary_polarity(spark, sf):
    return dataset.label_view(td.reviews(spark, sf), "binary_polarity",
                              keep=("id", "split"))


@query("corpus_records", with_views("reviews") + f"""
SELECT {sql_clean("text")} AS text, label AS label_id, coalesce(label_text, CAST(label AS VARCHAR)) AS label, split
FROM reviews""")
def corpus_records(spark, sf):
    return dataset.corpus_records(td.reviews(spark, sf))


@query("corpus_row_ids", with_views("reviews") + """
SELECT id, split, CAST(row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, id) - 1 AS BIGINT) AS row_id
FROM reviews""")
def corpus_row_ids(spark, sf):
    r = td.reviews(spark, sf).select("id", "split")
    return dataset.global_row_ids(r)
