"""Retrieval and question-answering queries.

Questions are every embedding row (its vector asks for its nearest corpus
rows); the corpus is the embeddings joined with their documents. The Spark
side searches tile against tile; the oracle is brute force over all pairs in
DuckDB.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from revscope.constants import NO_HITS_MESSAGE, STOP_WORDS, marker_lexicon
from revscope.functions import text as tx
from revscope.operators import qa, retrieval
from revscope.plans.q_features import SQL_TOKENS
from revscope.plans.q_text import _sql_focus
from revscope.plans.registry import query
from revscope.plans.sqlviews import SQL_WS, sql_clean, sql_label_name, with_views
from revscope.session import scratch_path
from revscope.sources import testdata as td

K = 5
_LEX = marker_lexicon()


_SQL_NORM = "sqrt(list_sum(list_transform({v}, lambda x: x * x)))"


def sql_hits(use_focus: bool, k: str = str(K), corpus: str = "corpus", questions: str = "questions", views: str | None = None, answerable: str = "true") -> str:
    """Brute force over all pairs: ``hits`` of every question, by true cosine."""
    eff = ("(SELECT l.label FROM labels l WHERE l.label = lower(q.sentiment_focus))"
           if use_focus else "CAST(NULL AS VARCHAR)")
    norm = lambda v: f"nullif({_SQL_NORM.format(v=v)}, 0)"
    return (views if views is not None else with_views("corpus", "questions")) + f"""
, labels AS (SELECT DISTINCT label FROM {corpus})
, qf AS (SELECT q.*, coalesce(nullif(q.focus, ''), {_sql_focus("q.question", _LEX)}) AS sentiment_focus FROM {questions} q)
, q AS (SELECT q.*, {eff} AS eff, {norm("q.q_vec")} AS norm FROM qf q)
, c AS (SELECT *, {norm("embedding")} AS norm FROM {corpus})
, pairs AS (SELECT q.q_id, {k} AS k, c.row_id, c.label,
                   round(1 - coalesce(list_dot_product(q.q_vec, c.embedding) / (q.norm * c.norm), 0), 6) + 0.0 AS distance
            FROM q JOIN c ON {answerable} AND (q.eff IS NULL OR c.label = q.eff))
, hits AS (SELECT q_id, CAST(rank AS INTEGER) AS rank, row_id, label, distance FROM (
             SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, row_id) AS rank FROM pairs) WHERE rank <= k)"""


def _questions(spark, sf):
    q = td.questions(spark, sf)
    return q.withColumn("sentiment_focus",
                        F.coalesce(tx.blank_to_null(F.col("focus")), tx.infer_focus("question", _LEX)))


def _hits(spark, sf, use_focus: bool = True):
    """Search once and materialise the hits (q × k rows): every QA step
    reads them, and the context payload comes from the index rows."""
    corpus = td.corpus(spark, sf)
    index = retrieval.build_index(corpus, "embedding", "label", "row_id", payload=("text", "label_id", "split"))
    q = _questions(spark, sf)
    hits = retrieval.search(q, index, K, focus_col="sentiment_focus" if use_focus else None)
    return hits.checkpoint(eager=True), index.rows.select("row_id", "text", "label_id", "split")


@query("search_topk", sql_hits(False) + "\nSELECT * FROM hits", headline=True)
def search_topk(spark, sf):
    return _hits(spark, sf, use_focus=False)[0]


@query("search_filtered", sql_hits(True) + "\nSELECT * FROM hits", headline=True)
def search_filtered(spark, sf):
    return _hits(spark, sf)[0]


def _stored_cells(spark, sf):
    """An index of cells, built of most of the corpus, with the rest appended."""
    from revscope.sources import index

    corpus, base = td.corpus(spark, sf), scratch_path(spark, "index")
    late = F.pmod(F.col("row_id"), F.lit(9)) == 0
    index.rebuild(corpus.filter(~late), base, payload=("text", "label_id", "split"),
                  meta={"collection_name": "reviews", "embedding_model": "precomputed", "batch_size": 64, "sample_size": None})
    index.append(corpus.filter(late), base)
    return index.open_index(spark, base)


@query("search_ivf", sql_hits(True) + "\nSELECT * FROM hits")
def search_ivf(spark, sf):
    """Build an index of cells, store it, append to it, reopen it (SNK5, SRC9); with every cell probed the result is exact."""
    found = _stored_cells(spark, sf)
    return found.search(_questions(spark, sf), K, focus_col="sentiment_focus", probes=len(found.model.centers))


@query("search_probed", with_views("questions") + """
SELECT count(*) AS questions, true AS recall_reached, true AS cells_grow FROM questions""")
def search_probed(spark, sf):
    """The same index with as many probes as were measured when it was built: its recall against the exact search."""
    from revscope.operators import cells

    found, q = _stored_cells(spark, sf), _questions(spark, sf)
    exact = retrieval.search(q, retrieval.build_index(td.corpus(spark, sf), "embedding", "label", "row_id"), K, focus_col=None)
    recall = cells.recall_at_k(found.search(q, K, focus_col=None), exact)
    n = len(found.model.centers)
    return q.agg(F.count(F.lit(1)).alias("questions")).select(
        "questions", F.lit(recall >= 0.9).alias("recall_reached"), F.lit(0.6 * found.metadata["size"] ** 0.5 <= n).alias("cells_grow"))


_SCALED = f"""
, scaled AS (SELECT row_id, text, split, label_id, CASE WHEN row_id % 7 <> 0 THEN CAST(label_id AS VARCHAR) END AS label,
                    list_transform(embedding, lambda x: x * (row_id % 5)) AS embedding FROM corpus)
, asked AS (SELECT q_id, question, list_transform(q_vec, lambda x: x * (1 + q_id % 3)) AS q_vec,
                   CASE q_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '2' WHEN 2 THEN 'none' END AS focus FROM questions)"""


@query("search_scaled", sql_hits(True, corpus="scaled", questions="asked", views=with_views("corpus", "questions") + _SCALED) + """
SELECT * FROM hits""")
def search_scaled(spark, sf):
    """Vectors of any length (some zero), null and numeric-looking labels, through a stored and reopened index."""
    from revscope.sources import io

    scale = F.pmod(F.col("row_id"), F.lit(5)).cast("double")
    corpus = (td.corpus(spark, sf)
              .withColumn("label", F.when(F.pmod(F.col("row_id"), F.lit(7)) != 0, F.col("label_id").cast("string")))
              .withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * scale)))
    path = scratch_path(spark, "index")
    io.write_index(retrieval.build_index(corpus, "embedding", "label", "row_id", payload=("text", "label_id", "split")), path, {})
    m = F.pmod(F.col("q_id"), F.lit(4))
    q = td.questions(spark, sf).select(
        "q_id", "question", F.transform("q_vec", lambda x: x.cast("double") * (1 + F.pmod(F.col("q_id"), F.lit(3)))).alias("q_vec"),
        F.when(m == 0, F.lit("0")).when(m == 1, F.lit("2")).when(m == 2, F.lit("none")).alias("focus"))
    q = q.withColumn("focus", F.coalesce("focus", tx.infer_focus("question", _LEX)))
    return retrieval.search(q, io.read_index(spark, path), K, focus_col="focus")


@query("context_label_mix", sql_hits(True) + """
SELECT q_id, label, count(*) AS n, min(rank) AS first_rank FROM hits GROUP BY q_id, label""")
def context_label_mix(spark, sf):
    return qa.label_mix(_hits(spark, sf)[0])


@query("dominant_label", sql_hits(True) + """
, mix AS (SELECT q_id, label, count(*) AS n, min(rank) AS first_rank FROM hits GROUP BY q_id, label)
SELECT q_id, label AS dominant_label, n AS dominant_n, k_found FROM (
  SELECT *, sum(n) OVER (PARTITION BY q_id) AS k_found,
         row_number() OVER (PARTITION BY q_id ORDER BY n DESC, first_rank) AS r FROM mix) WHERE r = 1""")
def dominant_label(spark, sf):
    return qa.dominant_label(qa.label_mix(_hits(spark, sf)[0]))


_KEY_PAT = r"[\p{L}\p{N}_][\p{L}\p{N}_-]+[\p{L}\p{N}_]"
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))) + "]"

_PHRASES_SQL = f"""
, ctx AS (SELECT h.q_id, h.row_id, c.text FROM hits h JOIN corpus c ON h.row_id = c.row_id)
, toks AS (SELECT q_id, row_id, list_filter(regexp_extract_all(lower(text), '{_KEY_PAT}'),
                                           lambda t: NOT list_contains({_STOP_SQL}, t)) AS a FROM ctx)
, terms AS (SELECT q_id, row_id, unnest(list_concat(a, CASE WHEN len(a) >= 2
              THEN list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) ELSE [] END)) AS term FROM toks)
, tf AS (SELECT q_id, row_id, term, count(*) AS tf FROM terms GROUP BY q_id, row_id, term)
, nq AS (SELECT q_id, count(*) AS n FROM (SELECT DISTINCT q_id, row_id FROM ctx) GROUP BY q_id)
, st AS (SELECT q_id, term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY q_id, term)
, voc AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY cf DESC, term) <= 1000)
, w AS (SELECT tf.q_id, tf.row_id, tf.term, tf.tf * (ln((1 + nq.n) / (1 + voc.df)) + 1) AS w
        FROM tf JOIN voc ON tf.q_id = voc.q_id AND tf.term = voc.term JOIN nq ON tf.q_id = nq.q_id)
, u AS (SELECT q_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY q_id, row_id)) AS u FROM w)
, sc AS (SELECT u.q_id, term, round(sum(u) / max(nq.n), 9) AS score FROM u JOIN nq ON u.q_id = nq.q_id GROUP BY u.q_id, term)
, phrases AS (SELECT q_id, CAST(rank AS INTEGER) AS rank, term AS phrase, score FROM (
    SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, term DESC) AS rank FROM sc
    WHERE NOT regexp_matches(term, '{qa.DIGIT_CLASS}')) WHERE rank <= 5)"""


@query("keyphrases", sql_hits(True) + _PHRASES_SQL + "\nSELECT * FROM phrases")
def keyphrases(spark, sf):
    hits, corpus = _hits(spark, sf)
    ctx = hits.join(corpus.select("row_id", "text"), "row_id")
    return qa.keyphrases(ctx)


def _sql_fixed4(x: str) -> str:
    v = f"(CAST(round({x} * 1000000) AS BIGINT) // 100 + CASE WHEN CAST(round({x} * 1000000) AS BIGINT) % 100 > 50 OR (CAST(round({x} * 1000000) AS BIGINT) % 100 = 50 AND (CAST(round({x} * 1000000) AS BIGINT) // 100) % 2 = 1) THEN 1 ELSE 0 END)"
    return f"(CAST({v} // 10000 AS VARCHAR) || '.' || lpad(CAST({v} % 10000 AS VARCHAR), 4, '0'))"


def _sql_truncate(t: str, n: int) -> str:
    return (f"CASE WHEN length({t}) <= {n} THEN {t} ELSE "
            f"regexp_replace(substr({t}, 1, {n - 3}), '{SQL_WS}+$', '') || '...' END")


_ANSWER_TAIL = _PHRASES_SQL + f"""
, hc AS (SELECT h.*, c.text, c.split, c.label_id FROM hits h JOIN corpus c ON h.row_id = c.row_id)
, agg AS (SELECT q_id, count(*) AS k, list(text ORDER BY rank) AS texts,
                 list('[' || rank || '] label=' || label || '; split=' || split || '; score=' || {_sql_fixed4("distance")}
                      || '; text=' || text ORDER BY rank) AS lines,
                 list(row_id ORDER BY rank) AS ids
          FROM hc GROUP BY q_id)
, mix AS (SELECT q_id, label, count(*) AS n, min(rank) AS first_rank FROM hits GROUP BY q_id, label)
, mixt AS (SELECT q_id, string_agg(label || ': ' || n, ', ' ORDER BY first_rank) AS distribution_text FROM mix GROUP BY q_id)
, dom AS (SELECT q_id, label AS dominant_label, n AS dominant_n FROM (
    SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY n DESC, first_rank) AS r FROM mix) WHERE r = 1)
, ph AS (SELECT q_id, list(phrase ORDER BY rank) AS phr FROM phrases GROUP BY q_id)
, a AS (
  SELECT qf.q_id, qf.question, qf.sentiment_focus, coalesce(agg.k, 0) AS k, agg.texts, agg.lines, agg.ids,
         coalesce(ph.phr, []::VARCHAR[]) AS phr, coalesce(mixt.distribution_text, '') AS distribution_text,
         dom.dominant_label, dom.dominant_n
  FROM qf LEFT JOIN agg ON qf.q_id = agg.q_id LEFT JOIN ph ON qf.q_id = ph.q_id
       LEFT JOIN mixt ON qf.q_id = mixt.q_id LEFT JOIN dom ON qf.q_id = dom.q_id)
, ans AS (
  SELECT *, CASE WHEN k = 0 THEN '{NO_HITS_MESSAGE}' ELSE concat_ws(' ',
      'Found ' || k || ' relevant reviews for: ' || question,
      'Most retrieved reviews are ' || dominant_label || ' (' || dominant_n || '/' || k || ').',
      CASE WHEN sentiment_focus IS NOT NULL THEN 'Sentiment focus applied: ' || sentiment_focus || '.' END,
      CASE WHEN len(phr) > 0 THEN 'Recurring themes: ' || array_to_string(phr[1:5], ', ') || '.' END,
      'Example evidence: ' || array_to_string(list_transform(texts[1:2], lambda t: {_sql_truncate("t", 120)}), '; '))
    END AS answer FROM a)"""
_ANSWER_SQL = sql_hits(True) + _ANSWER_TAIL


def answer_sql() -> str:
    """The CTEs from ``hits`` and ``qf`` to ``ans``, one answer per question."""
    return _ANSWER_TAIL


@query("extractive_answer", _ANSWER_SQL + "\nSELECT q_id, answer FROM ans")
def extractive_answer(spark, sf):
    return _answers(spark, sf).select("q_id", "answer")


def _answers(spark, sf, generator=None, config=None):
    hits, corpus = _hits(spark, sf)
    q = _questions(spark, sf)
    return qa.answer(q, hits, corpus, config or qa.GeneratorConfig(), generator=generator)


_PROMPT_SQL = """array_to_string(list_concat([
    'Answer in the language of the reviews, using only the evidence listed below.',
    'Say so when the evidence is thin and the conclusion only approximate.',
    'Question: ' || question,
    'Sentiment focus: ' || coalesce(sentiment_focus, 'not specified'),
    'Key phrases: ' || CASE WHEN len(phr) > 0 THEN array_to_string(phr, ', ') ELSE 'none' END,
    'Label distribution: ' || distribution_text,
    'Evidence:'], coalesce(lines, []::VARCHAR[]),
    ['Reply with a short answer and then two to four findings in one paragraph.']), chr(10))"""


@query("compose_prompt", _ANSWER_SQL + f"\nSELECT q_id, {_PROMPT_SQL} AS prompt FROM a")
def compose_prompt(spark, sf):
    a = _answers(spark, sf)
    return a.select("q_id", qa.compose_prompt(F.col("question"), F.col("contexts"), F.col("sentiment_focus"),
                                              F.col("keyphrases"), F.col("distribution_text")).alias("prompt"))


@query("context_caption", sql_hits(True) + f"""
, hc AS (SELECT h.*, c.split FROM hits h JOIN corpus c ON h.row_id = c.row_id)
SELECT q_id, rank, label || ' · ' || split || ' · score ' || {_sql_fixed4("distance")} AS caption FROM hc""")
def context_caption(spark, sf):
    hits, corpus = _hits(spark, sf)
    c = hits.join(corpus.select("row_id", "split"), "row_id")
    return c.select("q_id", "rank", qa.context_caption(F.col("label"), F.col("split"), F.col("distance")).alias("caption"))


@query("answer_questions", _ANSWER_SQL + """
SELECT q_id, question, answer, sentiment_focus, 'extractive' AS generation_mode, false AS llm_used,
       array_to_string(phr, ', ') AS keyphrases, distribution_text AS label_distribution,
       array_to_string(list_transform(coalesce(ids, []::BIGINT[]), lambda x: CAST(x AS VARCHAR)), ',') AS context_ids
FROM ans""", headline=True)
def answer_questions(spark, sf):
    a = _answers(spark, sf)
    return a.select("q_id", "question", "answer", "sentiment_focus", "generation_mode", "llm_used",
                    F.array_join("keyphrases", ", ").alias("keyphrases"),
                    F.col("distribution_text").alias("label_distribution"),
                    F.array_join(F.transform("contexts", lambda c: c["row_id"].cast("string")), ",")
                    .alias("context_ids"))


def _stub_generator(prompt: str) -> str:
    """A deterministic stand-in for a remote generator: fails on some prompts."""
    lines = prompt.split("\n")
    if len(prompt) % 7 == 0:
        raise RuntimeError("generator unavailable")
    return f"Generated summary over {sum(1 for x in lines if x.startswith('['))} reviews."


@query("generated_answer", _ANSWER_SQL + f"""
, p AS (SELECT q_id, k, answer, {_PROMPT_SQL} AS prompt FROM ans)
SELECT q_id, CASE WHEN length(prompt) % 7 = 0 THEN 'extractive' ELSE 'llm' END AS generation_mode, length(prompt) % 7 <> 0 AS llm_used,
       CASE WHEN length(prompt) % 7 = 0 THEN answer ELSE 'Generated summary over ' || k || ' reviews.' END AS answer FROM p""")
def generated_answer(spark, sf):
    cfg = qa.GeneratorConfig(mode="llm", model="stub", base_url="http://localhost:8080/v1")
    a = _answers(spark, sf, generator=_stub_generator, config=cfg)
    return a.select("q_id", "generation_mode", "llm_used", "answer")


@query("generation_mode", with_views("question_text") + """
SELECT conv_id, turn,
  CASE WHEN lower(coalesce(nullif(req, ''), 'auto')) = 'extractive' THEN 'extractive'
       WHEN model IS NOT NULL AND base_url IS NOT NULL
            AND NOT (contains(base_url, 'api.openai.com') AND api_key IS NULL) THEN 'llm'
       ELSE 'extractive' END AS generation_mode
FROM (SELECT conv_id, turn,
        CASE conv_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'LLM' WHEN 2 THEN 'weird' WHEN 3 THEN 'extractive' ELSE 'auto' END AS req,
        CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'model-a' END AS model,
        CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN 'https://api.openai.com/v1' ELSE 'http://localhost:8080/v1' END AS base_url,
        CASE WHEN conv_id % 2 = 0 THEN 'key' ELSE NULL END AS api_key
      FROM question_text)""")
def generation_mode(spark, sf):
    q = td.question_text(spark, sf)
    c, t = F.col("conv_id"), F.col("turn")
    req = (F.when(F.pmod(c, F.lit(5)) == 0, F.lit(None).cast("string")).when(F.pmod(c, F.lit(5)) == 1, F.lit("LLM"))
           .when(F.pmod(c, F.lit(5)) == 2, F.lit("weird")).when(F.pmod(c, F.lit(5)) == 3, F.lit("extractive"))
           .otherwise(F.lit("auto")))
    model = F.when(F.pmod(c, F.lit(3)) == 0, F.lit(None).cast("string")).otherwise(F.lit("model-a"))
    url = (F.when(F.pmod(t, F.lit(3)) == 0, F.lit(None).cast("string"))
           .when(F.pmod(t, F.lit(3)) == 1, F.lit("https://api.openai.com/v1")).otherwise(F.lit("http://localhost:8080/v1")))
    key = F.when(F.pmod(c, F.lit(2)) == 0, F.lit("key")).otherwise(F.lit(None).cast("string"))
    return q.select("conv_id", "turn", qa.mode_for(req, model, url, key).alias("generation_mode"))


def _sql_embed(name: str, docs: str, dim: int) -> str:
    """Counts of the hash buckets of the words of (id, text) rows."""
    return f"""
, {name}_t AS (SELECT id, unnest(list_transform({SQL_TOKENS}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim})) AS b FROM {docs})
, {name}_c AS (SELECT id, b, count(*) AS tf FROM {name}_t GROUP BY id, b)"""


@query("embed_corpus", with_views("all_docs") + f"""
, emb_docs AS (SELECT id, {sql_clean("text")} AS text FROM all_docs)""" + _sql_embed("e", "emb_docs", 64) + """
, idf AS (SELECT b, ln((1 + (SELECT count(*) FROM emb_docs)) / (1 + count(*))) + 1 AS idf FROM e_c GROUP BY b)
, w AS (SELECT id, e_c.b, tf * idf AS w FROM e_c JOIN idf ON e_c.b = idf.b)
, n AS (SELECT id, sqrt(sum(w * w)) AS norm, count(*) AS buckets, max(w) AS top, sum(w * (b + 1)) AS place FROM w GROUP BY id)
SELECT d.id, 64 AS dim, coalesce(n.buckets, 0)::INTEGER AS buckets, round(coalesce(n.top / n.norm, 0), 4) AS top, round(coalesce(n.place / n.norm, 0), 2) AS place
FROM emb_docs d LEFT JOIN n ON d.id = n.id""")
def embed_corpus(spark, sf):
    """Fit the encoder on all documents and embed them; facts that pin every component."""
    docs = td.all_docs(spark, sf).select("id", tx.clean_text("text").alias("text")).checkpoint()
    e = retrieval.encode(docs, retrieval.fit_encoder(docs, dim=64))
    place = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return e.select("id", F.size("embedding").alias("dim"), F.size(F.filter("embedding", lambda x: x != 0)).alias("buckets"),
                    F.round(F.array_max("embedding").cast("double"), 4).alias("top"), F.round(place, 2).alias("place"))


_ASK_DIM = 256


def _sql_vectors(name: str) -> str:
    """Dense unit vectors of the counts ``{name}_c`` under the IDF of ``idf``; texts without known words have none."""
    return f"""
, {name}_w AS (SELECT c.id, c.b, c.tf * coalesce(idf.idf, (SELECT ln(1 + n) + 1 FROM docs_n)) AS w FROM {name}_c c LEFT JOIN idf ON c.b = idf.b)
, {name}_v AS (SELECT id, list_transform(range({_ASK_DIM}), lambda i: coalesce(m[i], 0.0)) AS vec
               FROM (SELECT id, map_from_entries(list((b, w))) AS m FROM {name}_w GROUP BY id))"""


_ASK_VIEWS = with_views("all_docs", "question_text") + f"""
, emb_docs AS (SELECT id, {sql_clean("text")} AS text, id % 3 AS label_id, split FROM all_docs)
, asked AS (SELECT conv_id * 1000 + turn AS id, question AS text FROM question_text)
, docs_n AS (SELECT count(*) AS n FROM emb_docs)""" + _sql_embed("d", "emb_docs", _ASK_DIM) + _sql_embed("a", "asked", _ASK_DIM) + """
, idf AS (SELECT b, ln((1 + (SELECT n FROM docs_n)) / (1 + count(*))) + 1 AS idf FROM d_c GROUP BY b)""" + _sql_vectors("d") + _sql_vectors("a") + f"""
, zero AS (SELECT list_transform(range({_ASK_DIM}), lambda i: 0.0::DOUBLE) AS vec)
, corpus AS (SELECT d.id AS row_id, d.text, CAST(d.label_id AS INTEGER) AS label_id, {sql_label_name("d.label_id")} AS label, d.split,
                    coalesce(v.vec, zero.vec) AS embedding FROM emb_docs d LEFT JOIN d_v v ON d.id = v.id, zero)
, questions AS (SELECT a.id AS q_id, a.text AS question, coalesce(v.vec, zero.vec) AS q_vec, NULL::VARCHAR AS focus
                FROM asked a LEFT JOIN a_v v ON a.id = v.id, zero)"""


@query("ask_text", sql_hits(True, views=_ASK_VIEWS) + _ANSWER_TAIL + """
SELECT q_id, answer, sentiment_focus, k::INTEGER AS k FROM ans""")
def ask_text(spark, sf):
    """Questions as text: embedded by the corpus's encoder, searched and answered."""
    from revscope.operators.ask import ask

    docs = td.all_docs(spark, sf).select(
        F.col("id").alias("row_id"), tx.clean_text("text").alias("text"), F.pmod(F.col("id"), F.lit(3)).cast("int").alias("label_id"),
        td.label_name(F.pmod(F.col("id"), F.lit(3)).cast("int")).alias("label"), "split").checkpoint()
    encoder = retrieval.fit_encoder(docs)
    index = retrieval.build_index(retrieval.encode(docs, encoder), payload=("text", "label_id", "split"))
    requests = td.question_text(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("q_id"), "question")
    return ask(requests, index, encoder).select("q_id", "answer", "sentiment_focus", F.size("contexts").alias("k"))


_FLAWED = """
, sound AS (SELECT * FROM corpus WHERE row_id % 11 <> 0)
, flawed AS (SELECT q_id, question, q_vec, focus, q_id % 9 > 2 AS usable FROM questions)"""


@query("ask_flawed", sql_hits(True, corpus="sound", questions="flawed", views=with_views("corpus", "questions") + _FLAWED, answerable="q.usable") + _ANSWER_TAIL + """
SELECT q_id % 50 AS q_id, question, answer, k::INTEGER AS k FROM ans""")
def ask_flawed(spark, sf):
    """Requests that share ids, and vectors that are null, of another length or hold NaN, on both sides."""
    from revscope.operators.ask import ask

    nan = F.array(F.lit(float("nan")))
    doubles = lambda c: F.transform(c, lambda x: x.cast("double"))
    corpus = td.corpus(spark, sf).withColumn("embedding", F.when(F.pmod(F.col("row_id"), F.lit(11)) == 0, F.concat(nan, F.slice(doubles("embedding"), 2, 1000))).otherwise(doubles("embedding")))
    index = retrieval.build_index(corpus, "embedding", "label", "row_id", payload=("text", "label_id", "split"))
    kind, vec = F.pmod(F.col("q_id"), F.lit(9)), doubles("q_vec")
    flawed = (F.when(kind == 0, F.concat(nan, F.slice(vec, 2, 1000))).when(kind == 1, F.slice(vec, 1, 10)).when(kind == 2, F.lit(None).cast("array<double>"))
              .otherwise(vec))
    requests = td.questions(spark, sf).select(F.pmod(F.col("q_id"), F.lit(50)).alias("q_id"), "question", flawed.alias("q_vec"), "focus")
    return ask(requests, index).select("q_id", "question", "answer", F.size("contexts").alias("k"))
