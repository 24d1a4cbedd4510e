"""Streaming queries: the request jobs run with an available-now trigger
over a testdata table, which is one file or a folder of files, and the query
returns the written result table."""

from __future__ import annotations

from pyspark.sql import functions as F

from revscope.operators import dataset, retrieval
from revscope.operators import model as md
from revscope.plans.q_retrieval import answer_sql, sql_hits
from revscope.plans.registry import query
from revscope.plans.sqlviews import with_views
from revscope.session import scratch_path, table_path
from revscope.sources import testdata as td
from revscope.streaming import jobs

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _table_pattern(sf, name):
    """A pattern that only the table matches: a stream's source may be a folder or a pattern, but no plain file."""
    return table_path(sf, name)[:-1] + "[t]"


def _folders(spark, name):
    base = scratch_path(spark, name)
    return {"out_dir": f"{base}/out", "dead_dir": f"{base}/dead", "checkpoint_dir": f"{base}/checkpoint"}


@query("stream_predict", """
SELECT doc_id AS id, text, true AS label_is_best, true AS scores_sum_to_one FROM documents WHERE length(text) >= 1""")
def stream_predict(spark, sf):
    """A fitted model has no SQL: the rows are scored texts and facts that hold for every score."""
    r = td.reviews(spark, sf)
    train = dataset.label_view(r.filter(F.col("split") == "train"), "multiclass", keep=("id",))
    model = md.fit_baseline(train, md.BaselineConfig(feature_mode="word"))
    at = _folders(spark, "predict")
    jobs.stream_predict(spark, _table_pattern(sf, "documents"), DOC_SCHEMA, model, **at,
                        id_col="doc_id", text_col="text").awaitTermination()
    return spark.read.parquet(at["out_dir"]).select("id", "text", *md.score_facts())


_ASKED = """
, asked AS (SELECT vec_id AS q_id, 'Which reviews resemble item ' || CAST(vec_id AS VARCHAR) || '?' AS question,
                   CAST(embedding AS DOUBLE[]) AS q_vec,
                   CASE vec_id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' END AS focus,
                   vec_id % 23 - 1 AS top_k FROM embeddings WHERE vec_id % 23 - 1 BETWEEN 1 AND 20)"""


@query("stream_ask", sql_hits(True, k="q.top_k", questions="asked", views=with_views("corpus") + _ASKED) + answer_sql() + """
SELECT q_id, answer, 'extractive' AS generation_mode FROM ans""")
def stream_ask(spark, sf):
    corpus = td.corpus(spark, sf)
    index = retrieval.build_index(corpus, "embedding", "label", "row_id", payload=("text", "label_id", "split"))
    schema = "vec_id long, embedding array<float>, label int"

    def to_requests(raw):
        # every embedding row asks for its neighbours; some ask for k outside 1..20
        m = F.pmod(F.col("vec_id"), F.lit(4))
        return raw.select(
            F.col("vec_id").alias("q_id"),
            F.concat(F.lit("Which reviews resemble item "), F.col("vec_id").cast("string"), F.lit("?")).alias("question"),
            F.col("embedding").alias("q_vec"),
            F.when(m == 0, F.lit("negative")).when(m == 1, F.lit("positive")).alias("focus"),
            (F.pmod(F.col("vec_id"), F.lit(23)) - 1).cast("int").alias("top_k"))

    at = _folders(spark, "ask")
    jobs.stream_ask(spark, _table_pattern(sf, "embeddings"), schema, index, **at, to_requests=to_requests).awaitTermination()
    return spark.read.parquet(at["out_dir"]).select("q_id", "answer", "generation_mode")
