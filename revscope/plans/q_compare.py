"""Model-comparison queries over run tables derived from the predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from revscope.constants import DEFAULT_TASK_COLOUR, TASK_COLOURS
from revscope.operators import compare as cmp
from revscope.plans.registry import query
from revscope.plans.sqlviews import sql_class_scores, with_views
from revscope.sources import runs

_RUNS = with_views("predictions") + """
, expected AS (SELECT DISTINCT source AS model, CAST(substr(source, 4) AS INTEGER) AS ord FROM documents)
, pp AS (SELECT source AS model, label, pred, CAST(substr(source, 4) AS INTEGER) AS ord FROM predictions)
, art_rows AS (
  SELECT model, CASE WHEN ord % 4 IN (1, 3) THEN CAST(label = 2 AS INTEGER) ELSE label END AS y,
         CASE WHEN ord % 4 IN (1, 3) THEN CAST(pred = 2 AS INTEGER) ELSE pred END AS yp
  FROM pp WHERE ord % 3 <> 0 AND NOT (ord % 4 IN (1, 3) AND label = 1))
""" + sql_class_scores("art_rows", "y", "yp", "model", prefix="a_") + """
, run_metrics AS (
  SELECT s.model, CASE CAST(substr(s.model, 4) AS INTEGER) % 4 WHEN 1 THEN 'binary_polarity'
                       WHEN 2 THEN 'multiclass' ELSE NULL END AS task,
         acc.accuracy, s.f1_macro, s.f1_0, s.f1_1, s.f1_2
  FROM (SELECT model, avg(f1) AS f1_macro, max(f1) FILTER (WHERE cls = 0) AS f1_0,
               max(f1) FILTER (WHERE cls = 1) AS f1_1, max(f1) FILTER (WHERE cls = 2) AS f1_2
        FROM a_sc GROUP BY model) s
  JOIN (SELECT model, avg(CASE WHEN y = yp THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy
        FROM art_rows GROUP BY model) acc ON s.model = acc.model)
, run_metadata AS (
  SELECT model, CASE WHEN ord % 4 = 3 THEN 'binary_polarity' ELSE 'multiclass' END AS label_mode
  FROM expected WHERE ord % 3 <> 0 AND ord % 4 IN (2, 3))
, fb_rows AS (SELECT model, label AS y, pred AS yp FROM pp WHERE ord % 3 = 0 AND ord % 2 = 0)
""" + sql_class_scores("fb_rows", "y", "yp", "model", prefix="f_") + """
, run_fallback AS (
  SELECT s.model, CASE WHEN CAST(substr(s.model, 4) AS INTEGER) % 4 = 0 THEN 'previous_run' ELSE NULL END AS source,
         CAST(NULL AS VARCHAR) AS task, acc.accuracy, s.f1_macro
  FROM (SELECT model, avg(f1) AS f1_macro FROM f_sc GROUP BY model) s
  JOIN (SELECT model, avg(CASE WHEN y = yp THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy
        FROM fb_rows GROUP BY model) acc ON s.model = acc.model)
, art AS (
  SELECT m.*, coalesce(m.task, md.label_mode, 'multiclass') AS rtask
  FROM run_metrics m LEFT JOIN run_metadata md ON m.model = md.model)
, cmp_rows AS (
  SELECT model, 'artifacts/' || model AS artifacts_dir, rtask AS task, 'artifact' AS source,
         accuracy, f1_macro, f1_0 AS f1_negative,
         CASE WHEN rtask = 'binary_polarity' THEN NULL ELSE f1_1 END AS f1_neutral,
         CASE WHEN rtask = 'binary_polarity' THEN f1_1 ELSE f1_2 END AS f1_positive
  FROM art
  UNION ALL
  SELECT model, 'artifacts/' || model, coalesce(task, 'multiclass'), coalesce(source, 'fallback'),
         accuracy, f1_macro, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE
  FROM run_fallback WHERE model NOT IN (SELECT model FROM run_metrics))
, ranked AS (
  SELECT r.*, row_number() OVER (ORDER BY r.f1_macro DESC NULLS LAST, e.ord) AS rank
  FROM cmp_rows r JOIN expected e ON r.model = e.model)
, missing AS (
  SELECT * FROM expected WHERE model NOT IN (SELECT model FROM run_metrics)
                           AND model NOT IN (SELECT model FROM run_fallback))
"""


def _rows(spark, sf):
    return _ranked(runs.run_cells(spark, sf))


def _ranked(cells):
    return cmp.compare_runs(runs.expected_runs(cells), runs.run_metrics(cells), runs.run_metadata(cells), runs.run_fallback(cells))


@query("run_task", _RUNS + """
SELECT model, rtask AS task FROM art""")
def run_task(spark, sf):
    cells = runs.run_cells(spark, sf)
    return cmp.run_task(runs.run_metrics(cells), runs.run_metadata(cells)).select("model", "task")


@query("run_rows", _RUNS + """
SELECT * FROM cmp_rows WHERE source = 'artifact'""")
def run_rows(spark, sf):
    cells = runs.run_cells(spark, sf)
    m = cmp.run_task(runs.run_metrics(cells), runs.run_metadata(cells))
    return cmp.rows_from_metrics(m, "artifact")


@query("compare_models", _RUNS + """
SELECT * FROM ranked""", headline=True)
def compare_models(spark, sf):
    return _rows(spark, sf)


@query("missing_models", _RUNS + """
SELECT model, ord FROM missing""")
def missing_models(spark, sf):
    cells = runs.run_cells(spark, sf)
    return cmp.missing_runs(runs.expected_runs(cells), runs.run_metrics(cells), runs.run_fallback(cells))


@query("best_by_task", _RUNS + """
SELECT task, model AS best_model, f1_macro AS best_f1_macro FROM (
  SELECT *, row_number() OVER (PARTITION BY task ORDER BY f1_macro DESC NULLS LAST, rank) AS r FROM ranked)
WHERE r = 1""")
def best_by_task(spark, sf):
    return cmp.best_by_task(_rows(spark, sf))


@query("comparison_summary", _RUNS + """
SELECT (SELECT model FROM ranked WHERE rank = 1) AS best_model,
       (SELECT f1_macro FROM ranked WHERE rank = 1) AS best_f1_macro,
       (SELECT string_agg(model, ',' ORDER BY rank) FROM ranked) AS compared_models,
       (SELECT string_agg(model, ',' ORDER BY ord) FROM missing) AS missing_models""")
def comparison_summary(spark, sf):
    cells = runs.run_cells(spark, sf)
    # the ranked rows are one per run; written once, both results read them
    rows = _ranked(cells).checkpoint(eager=True)
    miss = cmp.missing_runs(runs.expected_runs(cells), runs.run_metrics(cells), runs.run_fallback(cells))
    return cmp.summary(rows, miss)


def _fmt(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE printf('%.4f', round_even({c}, 4)) END AS {c}"


@query("comparison_report", _RUNS + f"""
SELECT rank, model, task, source, {_fmt("accuracy")}, {_fmt("f1_macro")}, {_fmt("f1_negative")},
       {_fmt("f1_neutral")}, {_fmt("f1_positive")}
FROM ranked""")
def comparison_report(spark, sf):
    return cmp.report_rows(_rows(spark, sf))


_COLOURS = " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in TASK_COLOURS.items()) + f" ELSE '{DEFAULT_TASK_COLOUR}'"


@query("comparison_plot_rows", _RUNS + f"""
SELECT row_number() OVER (ORDER BY f1_macro ASC NULLS FIRST, rank DESC) AS bar, model, task,
       model || ' (' || task || ')' AS caption,
       CASE task {_COLOURS} END AS colour,
       f1_macro AS value, {_fmt("f1_macro").replace(" AS f1_macro", " AS value_text")}
FROM ranked""")
def comparison_plot_rows(spark, sf):
    return cmp.plot_rows(_rows(spark, sf), "f1_macro")


@query("run_log_long", _RUNS + """
, params AS (
  SELECT model, 'param' AS kind, k AS key,
         CASE WHEN json_type(j, '$.' || k) = 'VARCHAR' THEN json_extract_string(j, '$.' || k)
              ELSE CAST(json_extract(j, '$.' || k) AS VARCHAR) END AS value,
         NULL::DOUBLE AS num, json_type(j, '$.' || k) AS t
  FROM (SELECT model, json_object('model_family', 'tfidf_logreg', 'dataset_name', model, 'sample_size', NULL,
                                  'label_mode', coalesce(task, 'multiclass'), 'max_features', CAST(substr(model, 4) AS INTEGER),
                                  'regularization_c', 0.7, 'track_mlflow', CAST(substr(model, 4) AS INTEGER) % 2 = 0,
                                  'output_dir', json_object('path', 'artifacts/' || model)) AS j
        FROM run_metrics), unnest(json_keys(j)) AS u(k))
, mets AS (
  SELECT model, 'metric' AS kind, k AS key, NULL::VARCHAR AS value,
         CAST(json_extract(j, '$.' || k) AS DOUBLE) AS num, json_type(j, '$.' || k) AS t
  FROM (SELECT model, json_object('test_accuracy', accuracy, 'test_f1_macro', f1_macro,
                                  'epochs', CAST(substr(model, 4) AS INTEGER),
                                  'is_binary', task = 'binary_polarity',
                                  'nested', json_object('accuracy', accuracy), 'note', model) AS j
        FROM run_metrics), unnest(json_keys(j)) AS u(k))
SELECT model, kind, key, value, num FROM params WHERE t <> 'NULL'
UNION ALL
SELECT model, kind, key, value, num FROM mets WHERE t IN ('BIGINT', 'UBIGINT', 'DOUBLE')""")
def run_log_long(spark, sf):
    return cmp.flatten_run_log(runs.run_log_records(runs.run_cells(spark, sf)), "params", "metrics", "model")
