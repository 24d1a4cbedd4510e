"""Evaluation queries over the deterministic ``predictions`` view and the
``scored`` logits view."""

from __future__ import annotations

from pyspark.sql import functions as F

from revscope.constants import MULTICLASS_ID2LABEL
from revscope.functions.text import clean_text
from revscope.functions.vector import score_map
from revscope.operators import evaluate as ev
from revscope.plans.registry import query
from revscope.plans.sqlviews import sql_class_scores, sql_clean, with_views
from revscope.sources import testdata as td

NAMES = [MULTICLASS_ID2LABEL[i] for i in sorted(MULTICLASS_ID2LABEL)]


@query("accuracy", with_views("predictions") + """
SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy FROM predictions""")
def accuracy(spark, sf):
    return ev.accuracy(td.predictions(spark, sf))


@query("f1_macro", with_views("predictions") + sql_class_scores("predictions") + """
SELECT avg(f1) AS f1_macro FROM sc""", headline=True)
def f1_macro(spark, sf):
    return ev.f1_macro(td.predictions(spark, sf))


@query("classification_report", with_views("predictions") + sql_class_scores("predictions") + """
, tot AS (SELECT sum(support) AS n, sum(tp) AS tp_all, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
                 sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM sc)
SELECT CAST(cls AS VARCHAR) AS label, precision, recall, f1 AS f1_score, support FROM sc
UNION ALL SELECT 'accuracy', NULL, NULL, tp_all / n, CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'macro avg', mp, mr, mf, CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', wp / n, wr / n, wf / n, CAST(n AS BIGINT) FROM tot""")
def classification_report(spark, sf):
    return ev.classification_report(td.predictions(spark, sf))


_CONF_SQL = """
, dom AS (SELECT * FROM (VALUES (0, 'negative'), (1, 'neutral'), (2, 'positive')) v(t, true_label))
, cm AS (SELECT true_label,
    CAST(count(p.pred) FILTER (WHERE p.pred = 0) AS BIGINT) AS negative,
    CAST(count(p.pred) FILTER (WHERE p.pred = 1) AS BIGINT) AS neutral,
    CAST(count(p.pred) FILTER (WHERE p.pred = 2) AS BIGINT) AS positive
  FROM dom LEFT JOIN predictions p ON p.label = dom.t GROUP BY true_label)"""


@query("confusion_matrix", with_views("predictions") + _CONF_SQL + """
SELECT * FROM cm""")
def confusion_matrix(spark, sf):
    return ev.confusion_matrix(td.predictions(spark, sf), MULTICLASS_ID2LABEL)


@query("confusion_long", with_views("predictions") + _CONF_SQL + """
, long AS (UNPIVOT cm ON negative, neutral, positive INTO NAME pred_label VALUE n)
SELECT true_label, pred_label, n, n > max(n) OVER () / 2 AS is_dark FROM long""")
def confusion_long(spark, sf):
    return ev.confusion_long(ev.confusion_matrix(td.predictions(spark, sf), MULTICLASS_ID2LABEL))


_NAME = "CASE {c} WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' ELSE CAST({c} AS VARCHAR) END"


@query("error_table", with_views("predictions") + f"""
SELECT id, {sql_clean("text")} AS text, label AS true_label, pred AS pred_label,
       {_NAME.format(c="label")} AS true_label_text, {_NAME.format(c="pred")} AS pred_label_text
FROM predictions WHERE label <> pred""")
def error_table(spark, sf):
    p = td.predictions(spark, sf).withColumn("text", clean_text("text"))
    return ev.error_table(p, MULTICLASS_ID2LABEL, keep=("id",))


@query("label_names", with_views("predictions") + f"""
SELECT id, pred, {_NAME.format(c="pred")} AS pred_name FROM predictions""")
def label_names(spark, sf):
    p = td.predictions(spark, sf).select("id", "pred")
    return ev.attach_label_names(p, "pred", ev.id2label_frame(spark, MULTICLASS_ID2LABEL), "pred_name")


@query("join_predictions", with_views("reviews", "predictions") + """
SELECT r.id, r.split, r.label, p.pred FROM reviews r JOIN (SELECT id, pred FROM predictions) p ON r.id = p.id""")
def join_predictions(spark, sf):
    r = td.reviews(spark, sf).select("id", "split", "label")
    p = td.predictions(spark, sf).select("id", "pred")
    return r.join(p, "id")


_SOFTMAX_SQL = """
, sm AS (SELECT pos, label, logits,
           list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM scored)
, pr AS (SELECT pos, label, logits, list_transform(ex, lambda x: x / list_sum(ex)) AS probs,
                CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM sm)"""


@query("softmax_argmax", with_views("scored") + _SOFTMAX_SQL + """
SELECT pos, list_transform(probs, lambda x: round(x, 6)) AS probs, pred FROM pr""")
def softmax_argmax(spark, sf):
    s = ev.scored_from_logits(td.scored(spark, sf))
    return s.select("pos", F.transform("probs", lambda x: F.round(x, 6)).alias("probs"), "pred")


@query("score_logits", with_views("scored") + _SOFTMAX_SQL + f"""
SELECT pos, pred AS label_id, {_NAME.format(c="pred")} AS label,
       round_even(probs[1], 6) AS score_negative, round_even(probs[2], 6) AS score_neutral,
       round_even(probs[3], 6) AS score_positive
FROM pr""")
def score_logits(spark, sf):
    from revscope.operators.model import predictions_from_logits

    out = predictions_from_logits(td.scored(spark, sf), MULTICLASS_ID2LABEL, keep=("pos",))
    return out.select("pos", "label_id", "label",
                      *[F.col("scores")[n].alias(f"score_{n}") for n in NAMES])


def sql_percent_text(v: str) -> str:
    cents = f"((CAST(round({v} * 1000000) AS BIGINT) + 50) // 100)"
    return f"(CAST({cents} // 100 AS VARCHAR) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))"


@query("ranked_scores", with_views("scored") + _SOFTMAX_SQL + f"""
, e AS (SELECT pos, unnest(['negative', 'neutral', 'positive']) AS k,
               unnest(list_transform(probs, lambda x: round_even(x, 6))) AS v,
               unnest([1, 2, 3]) AS o FROM pr)
SELECT pos, string_agg(k || ' ' || {sql_percent_text("v")} || '%', '; ' ORDER BY v DESC, o) AS ranked
FROM e GROUP BY pos""")
def ranked_scores(spark, sf):
    from revscope.operators.compare import ranked_scores as rank

    s = ev.scored_from_logits(td.scored(spark, sf))
    s = s.withColumn("scores", score_map(F.array(*[F.lit(n) for n in NAMES]), F.col("probs")))
    return rank(s, "scores", keep=("pos",))


@query("batched_log_loss", with_views("scored") + _SOFTMAX_SQL + """
, ce AS (SELECT floor(pos / 16) AS batch, -ln(probs[label + 1]) AS ce FROM pr)
, b AS (SELECT batch, avg(ce) AS b, sum(ce) AS s, count(*) AS c FROM ce GROUP BY batch)
SELECT avg(b) AS loss, sum(s) / sum(c) AS row_mean_loss, count(*) AS batches FROM b""")
def batched_log_loss(spark, sf):
    s = ev.scored_from_logits(td.scored(spark, sf))
    return ev.batched_log_loss(s, "probs", "label", "pos", 16)


@query("certain_log_loss", with_views("scored") + _SOFTMAX_SQL + """
, sure AS (SELECT pos, label, CASE WHEN pos % 5 = 0 THEN list_transform(range(3), lambda i: CASE WHEN i = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
                                   ELSE probs END AS probs FROM pr)
, ce AS (SELECT floor(pos / 16) AS batch, CASE WHEN probs[label + 1] = 0 THEN 100.0::DOUBLE ELSE -ln(probs[label + 1]) END AS ce FROM sure)
, b AS (SELECT batch, avg(ce) AS b, sum(ce) AS s, count(*) AS c FROM ce GROUP BY batch)
SELECT avg(b) AS loss, sum(s) / sum(c) AS row_mean_loss, count(*) AS batches FROM b""")
def certain_log_loss(spark, sf):
    """Every fifth row is predicted with certainty; the wrong ones among them have probability 0."""
    s = ev.scored_from_logits(td.scored(spark, sf))
    sure = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == F.col("pred"), F.lit(1.0)).otherwise(F.lit(0.0)))
    s = s.withColumn("probs", F.when(F.pmod("pos", F.lit(5)) == 0, sure).otherwise(F.col("probs")))
    return ev.batched_log_loss(s, "probs", "label", "pos", 16)


@query("evaluate_scored", with_views("scored") + _SOFTMAX_SQL + sql_class_scores("pr") + """
, ce AS (SELECT floor(pos / 16) AS batch, -ln(probs[label + 1]) AS ce FROM pr)
, b AS (SELECT batch, avg(ce) AS b FROM ce GROUP BY batch)
SELECT (SELECT avg(b) FROM b) AS loss,
       (SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END)::DOUBLE FROM pr) AS accuracy,
       (SELECT avg(f1) FROM sc) AS f1_macro""")
def evaluate_scored(spark, sf):
    s = ev.scored_from_logits(td.scored(spark, sf))
    return ev.evaluate_epoch(s)


@query("best_epoch", with_views("history") + """
SELECT epoch, val_f1_macro, val_accuracy FROM history
ORDER BY val_f1_macro DESC, epoch ASC LIMIT 1""")
def best_epoch(spark, sf):
    return ev.best_epoch(td.history(spark, sf))


@query("checkpoint_epochs", with_views("history") + """
SELECT epoch, val_f1_macro FROM (
  SELECT epoch, val_f1_macro,
         max(val_f1_macro) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM history) WHERE prev IS NULL OR val_f1_macro > prev""")
def checkpoint_epochs(spark, sf):
    return ev.checkpoint_epochs(td.history(spark, sf))
