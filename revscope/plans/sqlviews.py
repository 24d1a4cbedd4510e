"""The testdata views of SURVEY §1.4 written as DuckDB SQL for the oracle.

``with_views("reviews", ...)`` returns a ``WITH`` prefix holding the named
views and everything they depend on, in dependency order.
"""

from __future__ import annotations

# Python's whitespace set as an RE2 class (RE2's \s lacks \x0b and Unicode).
SQL_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\p{Z}]"


def sql_clean(expr: str) -> str:
    """STR1 in DuckDB: the four entities of the testdata, `&amp;` last."""
    unesc = (f"replace(replace(replace(replace({expr}, '&quot;', '\"'), '&copy;', '©'), "
             f"'&middot;', '·'), '&amp;', '&')")
    no_tags = f"regexp_replace({unesc}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({no_tags}, '{SQL_WS}+', ' ', 'g'))"


def sql_label_name(expr: str) -> str:
    return (f"CASE {expr} WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' "
            f"WHEN 2 THEN 'positive' ELSE CAST({expr} AS VARCHAR) END")


def sql_split(expr: str) -> str:
    return (f"CASE WHEN {expr} % 5 < 3 THEN 'train' WHEN {expr} % 5 = 3 "
            f"THEN 'validation' ELSE 'test' END")


_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "reviews": ((), f"""
SELECT d.doc_id AS id, d.text,
       CAST(CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 0 THEN 1 ELSE 2 END AS INTEGER) AS label,
       {sql_label_name("CAST(CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 0 THEN 1 ELSE 2 END AS INTEGER)")} AS label_text,
       {sql_split("d.doc_id")} AS split,
       d.source
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
    "all_docs": ((), f"""
SELECT doc_id AS id, text, lang, source, {sql_split("doc_id")} AS split FROM documents"""),
    "raw_html": ((), "SELECT page_id, html AS text FROM pages"),
    "predictions": (("reviews",), """
SELECT *, CAST(CASE WHEN id % 7 = 0 THEN (label + 1) % 3
                    WHEN id % 11 = 0 THEN (label + 2) % 3
                    ELSE label END AS INTEGER) AS pred
FROM reviews"""),
    "corpus": ((), f"""
SELECT e.vec_id AS row_id, {sql_clean("d.text")} AS text,
       CAST(e.label % 3 AS INTEGER) AS label_id,
       {sql_label_name("CAST(e.label % 3 AS INTEGER)")} AS label,
       {sql_split("e.vec_id")} AS split,
       CAST(e.embedding AS DOUBLE[]) AS embedding
FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id"""),
    "questions": ((), """
SELECT vec_id AS q_id,
       'Which reviews resemble item ' || CAST(vec_id AS VARCHAR) || '?' AS question,
       CAST(embedding AS DOUBLE[]) AS q_vec,
       CASE vec_id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive'
                       WHEN 2 THEN 'missing' ELSE NULL END AS focus
FROM embeddings"""),
    "scored": ((), """
SELECT vec_id AS pos, CAST(label % 3 AS INTEGER) AS label,
       list_transform(range(3), lambda j: list_sum(list_transform(list_filter(range(len(embedding)), lambda i: i % 3 = j),
                                                                  lambda i: CAST(embedding[i + 1] AS DOUBLE))) * 10.0) AS logits
FROM embeddings"""),
    "history": (("predictions",), """
SELECT CAST(id % 6 + 1 AS DOUBLE) AS epoch,
       avg(abs(CAST(label - pred AS DOUBLE))) AS train_loss,
       avg(CAST(label - pred AS DOUBLE) * CAST(label - pred AS DOUBLE)) AS val_loss,
       avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END)::DOUBLE AS val_accuracy,
       round_even(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END)::DOUBLE, 1) AS val_f1_macro
FROM predictions GROUP BY id % 6"""),
    "question_text": ((), """
SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'"""),
}


def register_view(name: str, deps: tuple[str, ...], body: str) -> None:
    _VIEWS[name] = (deps, body)


def with_views(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return ""
    parts = [f"{n} AS ({_VIEWS[n][1].strip()})" for n in order]
    return "WITH " + ",\n".join(parts) + "\n"


def sql_class_scores(src: str, true: str = "label", pred: str = "pred", by: str = "",
                     prefix: str = "", lead: str = ",") -> str:
    """Per-class support/predicted/tp and precision/recall/f1 as SQL CTEs
    named ``{prefix}cc`` and ``{prefix}sc`` over relation ``src``."""
    b = f"{by}, " if by else ""
    return f"""
{lead} {prefix}pairs AS (SELECT {b}{true} AS cls, 1 AS s, CASE WHEN {true} = {pred} THEN 1 ELSE 0 END AS tp, 0 AS pc FROM {src}
            UNION ALL SELECT {b}{pred} AS cls, 0, 0, 1 FROM {src})
, {prefix}cc AS (SELECT {b}cls, CAST(sum(s) AS BIGINT) AS support, CAST(sum(pc) AS BIGINT) AS predicted,
                CAST(sum(tp) AS BIGINT) AS tp FROM {prefix}pairs GROUP BY {b}cls)
, {prefix}sc AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
                CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
                CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0.0 END AS f1
         FROM {prefix}cc)"""
