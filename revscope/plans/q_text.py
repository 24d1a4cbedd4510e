"""Scalar text-function queries (STR1-STR7, STR3, FLT8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from revscope.functions import text as tx
from revscope.operators import requests as rq
from revscope.plans.registry import query
from revscope.plans.sqlviews import SQL_WS, sql_clean, with_views
from revscope.sources import testdata as td

# The testdata has no Russian, so the focus queries over it take a lexicon of
# substrings that occur in its languages; the fixed Russian lexicon is the
# default everywhere else (and is what the unit tests check).
TESTDATA_LEXICON = [("nicht", "negative", 0), ("pas ", "negative", 0),
                    ("the ", "positive", 1), ("que", "neutral", 2)]


@query("clean_text", with_views("raw_html") + f"""
SELECT page_id, {sql_clean("text")} AS text FROM raw_html""", headline=True)
def clean_text(spark, sf):
    return td.raw_html(spark, sf).select("page_id", tx.clean_text("text").alias("text"))


@query("truncate_text", with_views("all_docs") + f"""
SELECT id, CASE WHEN length(text) <= 220 THEN text
           ELSE regexp_replace(substr(text, 1, 217), '{SQL_WS}+$', '') || '...' END AS snippet
FROM all_docs""")
def truncate_text(spark, sf):
    return td.all_docs(spark, sf).select("id", tx.truncate("text", 220).alias("snippet"))


@query("word_tokens", with_views("all_docs") + r"""
SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS tokens FROM all_docs""")
def word_tokens(spark, sf):
    return td.all_docs(spark, sf).select("id", tx.word_tokens("text").alias("tokens"))


@query("keyphrase_tokens", with_views("all_docs") + r"""
SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_-]+[\p{L}\p{N}_]') AS tokens
FROM all_docs""")
def keyphrase_tokens(spark, sf):
    return td.all_docs(spark, sf).select("id", tx.keyphrase_tokens("text").alias("tokens"))


@query("word_ngrams", with_views("reviews") + r"""
, t AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS a FROM reviews)
SELECT id, list_concat(a, CASE WHEN len(a) >= 2
         THEN list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])
         ELSE [] END) AS grams
FROM t""")
def word_ngrams(spark, sf):
    r = td.reviews(spark, sf)
    return r.select("id", tx.word_ngrams(tx.word_tokens("text"), 1, 2).alias("grams"))


def sql_char_grams(t: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({t}), '{SQL_WS}+'), lambda x: x <> '')"
    return f"""flatten(list_transform({words}, lambda w: flatten(list_transform([3, 4, 5], lambda n:
      CASE WHEN n <= length(w) + 2
           THEN list_transform(range(1, length(w) + 2 - n + 2), lambda i: substr(' ' || w || ' ', i, n))
           ELSE [] END))))"""


@query("char_ngrams", with_views("reviews") + f"""
SELECT id, {sql_char_grams("text")} AS grams FROM reviews""")
def char_ngrams(spark, sf):
    r = td.reviews(spark, sf)
    return r.select("id", tx.char_wb_ngrams("text", 3, 5).alias("grams"))


def _sql_focus(q: str, lexicon) -> str:
    by: dict[str, list[str]] = {}
    prio: dict[str, int] = {}
    for m, f, p in lexicon:
        by.setdefault(f, []).append(m)
        prio[f] = min(p, prio.get(f, p))
    whens = []
    for f in sorted(by, key=lambda x: prio[x]):
        cond = " OR ".join(f"contains(lower({q}), '{m}')" for m in by[f])
        whens.append(f"WHEN {cond} THEN '{f}'")
    return "CASE " + " ".join(whens) + " ELSE NULL END"


@query("infer_focus", with_views("question_text") + f"""
SELECT conv_id, turn, {_sql_focus("question", TESTDATA_LEXICON)} AS focus FROM question_text""")
def infer_focus(spark, sf):
    q = td.question_text(spark, sf)
    return q.select("conv_id", "turn", tx.infer_focus("question", TESTDATA_LEXICON).alias("focus"))


@query("validate_requests", with_views("question_text") + """
, r AS (SELECT conv_id, turn, question,
               CASE WHEN conv_id % 10 = 9 THEN NULL ELSE CAST((conv_id * 7 + turn) % 23 - 1 AS INTEGER) END AS top_k
        FROM question_text)
SELECT conv_id, turn, question, CAST(coalesce(top_k, 5) AS INTEGER) AS top_k,
       (coalesce(length(question) >= 3, false) AND coalesce(top_k, 5) BETWEEN 1 AND 20) AS valid,
       CASE WHEN question IS NULL OR length(question) < 3 THEN 'question must have at least 3 characters'
            WHEN coalesce(top_k, 5) NOT BETWEEN 1 AND 20 THEN 'top_k must be between 1 and 20'
            ELSE NULL END AS reason
FROM r""")
def validate_requests(spark, sf):
    q = td.question_text(spark, sf)
    top_k = F.when(F.pmod(F.col("conv_id"), F.lit(10)) == 9, F.lit(None).cast("int")) \
        .otherwise((F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(23)) - 1).cast("int"))
    reqs = q.select("conv_id", "turn", "question", top_k.alias("top_k"))
    return rq.validate_ask(reqs)


SQL_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


@query("infer_focus_table", with_views("question_text", "all_docs") + f"""
, words AS (SELECT DISTINCT unnest({SQL_WORDS}) AS marker FROM benchmark)
, lexicon AS (SELECT marker, ['negative', 'neutral', 'positive'][length(marker) % 3 + 1] AS focus, CAST(length(marker) % 7 AS INTEGER) AS priority FROM words)
, ranks AS (SELECT focus, min(priority) AS priority FROM lexicon GROUP BY focus)
, found AS (SELECT q.conv_id, q.turn, min(struct_pack(p := r.priority, f := r.focus)) AS best
            FROM question_text q JOIN lexicon l ON contains(lower(q.question), l.marker) JOIN ranks r ON l.focus = r.focus GROUP BY q.conv_id, q.turn)
SELECT q.conv_id, q.turn, found.best.f AS focus FROM question_text q LEFT JOIN found ON q.conv_id = found.conv_id AND q.turn = found.turn""")
def infer_focus_table(spark, sf):
    """The focus of every question by a lexicon that is a table: all words of the benchmark texts."""
    from revscope.operators import lexicon

    words = td.table(spark, sf, "benchmark").select(F.explode(tx.word_tokens("text")).alias("marker")).distinct()
    size = F.length("marker")
    focus = F.element_at(F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")), (F.pmod(size, F.lit(3)) + 1).cast("int"))
    table = words.select("marker", focus.alias("focus"), F.pmod(size, F.lit(7)).cast("int").alias("priority"))
    return lexicon.infer_focus(td.question_text(spark, sf).select("conv_id", "turn", "question"), table).select("conv_id", "turn", "focus")


@query("marker_counts", with_views("question_text") + f"""
, words AS (SELECT DISTINCT unnest({SQL_WORDS}) AS marker FROM benchmark)
SELECT w.marker, count(q.question) AS texts FROM words w LEFT JOIN question_text q ON contains(lower(q.question), w.marker) GROUP BY w.marker""")
def marker_counts(spark, sf):
    from revscope.operators import lexicon

    words = td.table(spark, sf, "benchmark").select(F.explode(tx.word_tokens("text")).alias("marker"))
    return lexicon.marker_counts(td.question_text(spark, sf), words)
