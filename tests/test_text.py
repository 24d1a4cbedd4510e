"""Scalar text functions against Python reference implementations."""

import html
import re

from pyspark.sql import functions as F

from revscope.constants import marker_lexicon
from revscope.functions import text as tx


def py_clean(t):
    t = html.unescape(t)
    t = re.sub(r"<[^>]+>", " ", t)
    t = re.sub(r"\s+", " ", t)
    return t.strip()


def py_char_wb(text, lo=3, hi=5):
    out = []
    for w in text.lower().split():
        w = " " + w + " "
        n_len = len(w)
        for n in range(lo, hi + 1):
            off = 0
            out.append(w[off:off + n])
            while off + n < n_len:
                off += 1
                out.append(w[off:off + n])
            if off == 0:
                break
    return out


CLEAN_CASES = [
    "a b c\x1cd", "&lt;b&gt;x&lt;/b&gt;", "keep <> this", "tag <a\nhref='x'>inside</a> end",
    "&amp;middot; once", "  spaced \t\n out  ", "", "&copy; &quot;q&quot; &middot;", "<p>Hello</p><br/>World",
]


def rows(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def test_clean_text_matches_python(spark):
    df = rows(spark, CLEAN_CASES + [None]).select("i", tx.clean_text("t").alias("c"))
    got = {r.i: r.c for r in df.collect()}
    for i, v in enumerate(CLEAN_CASES):
        assert got[i] == py_clean(v), (v, got[i])
    assert got[len(CLEAN_CASES)] is None


def test_empty_texts(spark):
    vals = [None, "", "  ", "\t\t", " x "]
    got = [r.e for r in rows(spark, vals).orderBy("i").select(tx.is_empty_text("t").alias("e")).collect()]
    assert got == [True, True, True, True, False]


WORDS = ["ёлка и ёж", "x² ½ под_черк a b ab", "Wi-Fi ab--cd -abc abc- ab- до", "Hello, World! 42"]


def test_word_tokens_match_python(spark):
    got = [r.a for r in rows(spark, WORDS).orderBy("i").select(tx.word_tokens("t").alias("a")).collect()]
    want = [re.findall(r"(?u)\b\w\w+\b", w.lower()) for w in WORDS]
    assert got == want


def test_keyphrase_tokens_match_python(spark):
    got = [r.a for r in rows(spark, WORDS).orderBy("i").select(tx.keyphrase_tokens("t").alias("a")).collect()]
    want = [re.findall(r"(?u)\b[\w-]{3,}\b", w.lower()) for w in WORDS]
    assert got == want


def test_word_ngrams_edges(spark):
    df = spark.createDataFrame([(0, []), (1, ["a"]), (2, ["a", "b"]), (3, ["a", "a", "a"])], "i int, a array<string>")
    got = [r.g for r in df.orderBy("i").select(tx.word_ngrams(F.col("a"), 1, 2).alias("g")).collect()]
    assert got == [[], ["a"], ["a", "b", "a b"], ["a", "a", "a", "a a", "a a"]]
    tri = [r.g for r in df.orderBy("i").select(tx.ngrams(F.col("a"), 3).alias("g")).collect()]
    assert tri == [[], [], [], ["a a a"]]


def test_char_wb_ngrams_match_python(spark):
    texts = ["я да мир", "a", "abc", "word, glued!", "Привет  мир\tснова"]
    got = [r.g for r in rows(spark, texts).orderBy("i").select(tx.char_wb_ngrams("t").alias("g")).collect()]
    assert got == [py_char_wb(t) for t in texts]


def test_truncate(spark):
    long = "word " * 60
    got = [r.s for r in rows(spark, ["short", long]).orderBy("i").select(tx.truncate("t", 20).alias("s")).collect()]
    assert got[0] == "short"
    assert got[1] == long[:17].rstrip() + "..."


def test_infer_focus_priority(spark):
    qs = ["Какие ПРОБЛЕМЫ и плюсы?", "Что нравится людям?", "Обычное мнение", "Просто вопрос"]
    got = [r.f for r in rows(spark, qs).orderBy("i").select(tx.infer_focus("t", marker_lexicon()).alias("f")).collect()]
    assert got == ["negative", "positive", "neutral", None]


def test_fixed4_half_even(spark):
    df = spark.createDataFrame([(0.12345,), (0.12355,), (1.5,), (0.0,)], "x double")
    got = [r.s for r in df.select(tx.fixed4("x").alias("s")).collect()]
    assert got == ["0.1234", "0.1236", "1.5000", "0.0000"]
