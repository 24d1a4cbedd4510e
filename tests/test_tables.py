"""Lexicon tables, sub-word ids, shuffled batches, large samples, generator calls, run log, zero probabilities."""

import math
import os
import random
import tempfile
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from revscope.functions import text as tx
from revscope.operators import evaluate, features, lexicon, loader, profile, qa, subwords
from revscope.sources import io


# ---- lexicon tables ----------------------------------------------------------------------

MARKERS = [("bad", "negative", 0), ("a b", "negative", 3), ("good", "positive", 1), ("oo", "positive", 1), ("é", "neutral", 2), ("so-so", "neutral", 2),
           ("", "negative", 0), (None, "negative", 0), ("good", "positive", 1), ("zzz", None, 0), ("last", "zero", None), ("bad", "also", 0)]


def brute_focus(text):
    rank = {}
    for m, f, p in MARKERS:
        if m and f:
            rank[f] = min(rank.get(f, 2**31), 2**31 - 1 if p is None else p)
    found = [(rank[f], f) for m, f, _ in MARKERS if m and f and text is not None and m in text.lower()]
    return min(found)[1] if found else None


def test_focus_by_a_lexicon_table(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "BAD", "a  b", "a b", "so-so é", "noon", "the last one", "zzz"] + ["".join(rng.choice("abdgo é-s") for _ in range(rng.randint(1, 25))) for _ in range(300)]
    rows = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate(texts)], "q_id int, question string, gram string")
    table = spark.createDataFrame(MARKERS, "marker string, focus string, priority int")
    got = lexicon.infer_focus(rows, table)
    assert got.columns == ["q_id", "question", "gram", "focus"]
    assert Counter((r.q_id, r.question, r.focus) for r in got.collect()) == Counter((i % 50, t, brute_focus(t)) for i, t in enumerate(texts))
    empty = spark.createDataFrame([], table.schema)
    assert lexicon.infer_focus(rows, empty).filter("focus IS NOT NULL").count() == 0
    assert lexicon.infer_focus(rows.limit(0), table).count() == 0
    counts = {r.marker: r.texts for r in lexicon.marker_counts(rows, table).collect()}
    assert counts == {m: sum(m in (t or "").lower() for t in texts) for m, _, _ in MARKERS if m}


def test_a_table_decides_as_the_fixed_list_does(spark):
    fixed = [("плохо", "negative", 0), ("плюс", "positive", 1), ("быстро", "positive", 1), ("средне", "neutral", 2)]
    rows = spark.createDataFrame([("Почему ПЛОХО и быстро?",), ("плюсы",), ("средне",), ("иное",), (None,)], "question string")
    table = spark.createDataFrame(fixed, "marker string, focus string, priority int")
    got = lexicon.infer_focus(rows, table, out_col="by_table").withColumn("by_list", tx.infer_focus("question", fixed)).collect()
    assert all(r.by_table == r.by_list for r in got) and sum(r.by_table is not None for r in got) == 3


def test_a_large_lexicon_needs_no_nested_loop(spark):
    table = spark.range(200_000).selectExpr("lower(concat('m', hex(id * 7919), 'x')) AS marker", "if(id % 2 = 0, 'even', 'odd') AS focus", "cast(id % 2 AS int) AS priority")
    rows = spark.createDataFrame([(i, f"about m{i * 7919:X}x here") for i in range(0, 200_000, 5_001)], "id long, question string")
    found = lexicon.infer_focus(rows, table)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.focus for r in found.collect()} == {i: "even" if i % 2 == 0 else "odd" for i in range(0, 200_000, 5_001)}


# ---- token ids ---------------------------------------------------------------------------

def greedy_merges(word: str, ranks: dict) -> list[str]:
    parts = list(word)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get((parts[i], parts[i + 1]), 1 << 30))
        if (parts[best], parts[best + 1]) not in ranks:
            break
        pair = (parts[best], parts[best + 1])
        out, i = [], 0
        while i < len(parts):
            if tuple(parts[i:i + 2]) == pair:
                out.append(pair[0] + pair[1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def test_subwords_against_plain_merging(spark):
    import json

    model = json.load(open(subwords.default_vocabulary()))["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ranks = {m: i for i, m in enumerate(merges)}
    texts = ["the unbelievable encyclopaedias", "hello", "antidisestablishmentarianism zxqj"]
    want = {t: [model["vocab"][p] for i, w in enumerate(t.split(" ")) for p in greedy_merges(("Ġ" if i else "") + w, ranks)] for t in texts}
    rows = [(1, t) for t in texts] + [(1, None), (None, texts[0]), (2, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = subwords.encode_subwords(docs, subwords.default_vocabulary(), 8, start_id=50256, end_id=50256).collect()
    assert len(got) == 6 and all(r.attention_mask == [1] * len(r.input_ids) and len(r.input_ids) <= 8 for r in got)
    for r in got:
        if r.text in want:
            assert r.input_ids == [50256, *want[r.text][:6], 50256]
    assert [r.input_ids for r in got if r.text is None] == [[50256, 50256]]
    assert len([r for r in got if r.text == "<|endoftext|>"][0].input_ids) > 3
    back = subwords.decode_subwords(subwords.encode_subwords(docs, subwords.default_vocabulary(), None), subwords.default_vocabulary()).collect()
    assert [r.decoded for r in back] == [r.text or "" for r in back]
    assert subwords.encode_subwords(docs.limit(0), subwords.default_vocabulary()).count() == 0
    with pytest.raises(ValueError):
        subwords.encode_subwords(docs, subwords.default_vocabulary(), 1, start_id=1, end_id=2)


def test_rows_that_share_an_id_are_encoded_each_on_its_own(spark):
    vocab = spark.createDataFrame([("aa", 2), ("bb", 3)], "token string, token_id int")
    docs = spark.createDataFrame([(1, "aa bb"), (1, "bb"), (None, "aa cc aa"), (2, None), (1, "bb")], "id long, text string")
    got = Counter((r.id, tuple(r.input_ids), tuple(r.attention_mask)) for r in features.encode_tokens(docs, vocab, 2).collect())
    assert got == Counter({(1, (2, 3), (1, 1)): 1, (1, (3,), (1,)): 2, (None, (2, 1), (1, 1)): 1, (2, (), ()): 1})


# ---- shuffled batches --------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_places_are_a_bijection(spark, n):
    places = [[r.p for r in spark.range(n).select(loader.shuffled_place(F.col("id"), n, 5, epoch).alias("p")).collect()] for epoch in (0, 1, 0)]
    assert all(sorted(p) == list(range(n)) for p in places) and places[0] == places[2]
    if n == 1000:
        assert places[0] != places[1]
        assert sum(abs(i - p) for i, p in enumerate(places[0])) / n == pytest.approx(n / 3, rel=0.15)
        assert sum(places[0][i + 1] - places[0][i] == 1 for i in range(n - 1)) < 10


def test_batches_hold_every_row_once_and_rows_of_like_length(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, [7] * (k := rng.randint(0, 40)), [1] * k) for i in range(333)], "row_id long, input_ids array<int>, attention_mask array<int>")
    padding = {}
    for pool in (1, 5):
        got = loader.shuffled_batches(rows, 8, seed=1, epoch=3, pool=pool).collect()
        assert sorted(r.row_id for r in got) == list(range(333)) and sorted(r.place for r in got) == list(range(333))
        sizes = Counter(r.batch for r in got)
        assert sorted(sizes) == list(range(42)) and all(sizes[b] == 8 for b in range(41))
        assert all(len({len(r.input_ids) for r in got if r.batch == b}) == 1 for b in sizes)
        padding[pool] = sum(r.attention_mask.count(0) for r in got)
    assert padding[5] < padding[1] / 2
    assert loader.shuffled_batches(rows.limit(0), 8).count() == 0


# ---- samples -----------------------------------------------------------------------------

@pytest.mark.parametrize("bins", [1 << 16, 4, 1])
def test_samples_are_the_rows_of_least_key(spark, monkeypatch, bins):
    monkeypatch.setattr(profile, "BINS", bins)
    rows = [(i, s) for i in range(400) for s in ("train", "test", None)] + [(None, "train"), (None, "train"), (7, "train")]
    df = spark.createDataFrame(rows, "id long, split string")
    for n in (0, 1, 17, 399, 402, 5000):
        got = Counter(map(tuple, profile.sample_per_split(df, n).collect()))
        import hashlib
        key = lambda r: (r[0] is not None, hashlib.md5(f"{r[0]}-42".encode()).hexdigest(), r[0])
        want = Counter(r for s in ("train", "test", None) for r in sorted([r for r in rows if r[1] == s], key=key)[:n])
        assert got == want, n


# ---- generator calls ---------------------------------------------------------------------

def test_a_hanging_generator_ends_in_the_fallback():
    seen = []

    def generator(prompt):
        seen.append(prompt)
        if "hang" in prompt:
            time.sleep(30)
        if "fail" in prompt:
            raise RuntimeError("no")
        if prompt == "second try" and seen.count(prompt) < 2:
            raise RuntimeError("not yet")
        return f" {prompt}! "

    cfg = qa.GeneratorConfig(timeout=0.5, retries=1, concurrency=3)
    began = time.monotonic()
    assert qa.bounded_calls(generator, ["a", "hang", "fail", "second try", "b"], cfg, []) == ["a!", None, None, "second try!", "b!"]
    assert time.monotonic() - began < 5 and seen.count("fail") == 2
    hung: list = []
    assert qa.bounded_calls(generator, ["hang"] * 9 + ["c"], qa.GeneratorConfig(timeout=0.2, concurrency=2), hung) == [None] * 10
    assert len(hung) == 2  # never more threads than may be under way
    assert qa.bounded_calls(lambda p, system: f"{system}:{p}", ["x"], qa.GeneratorConfig(system="S"), []) == ["S:x"]


def test_calls_are_bounded_and_prompts_asked_once(spark):
    folder = tempfile.mkdtemp(prefix="calls-")

    def generator(prompt):
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return prompt.upper()

    rows = [(1, "llm", "same"), (1, "llm", "same"), (None, "llm", "other"), (3, "extractive", "same"), (4, "llm", None)]
    df = spark.createDataFrame(rows, "q_id long, generation_mode string, prompt string")
    got = Counter((r.q_id, r.generated) for r in qa.generated_answers(df, generator).collect())
    assert got == Counter({(1, "SAME"): 2, (None, "OTHER"): 1, (3, None): 1, (4, None): 1}) and len(os.listdir(folder)) == 2


# ---- run log, finished tables, losses ----------------------------------------------------

def test_a_run_logged_twice_stands_once(spark):
    path = tempfile.mkdtemp(prefix="log-")
    log = spark.createDataFrame([("m", "metric", "f1", None, 0.5)], "model string, kind string, key string, value string, num double")
    assert io.read_run_log(spark, path).count() == 0 and io.append_run_log(log, path, enabled=False) is None
    for _ in range(2):
        io.append_run_log(log, path, run_id="job-1")
    io.append_run_log(log, path)
    assert io.read_run_log(spark, path).count() == 2 and {r.run for r in io.read_run_log(spark, path).collect()} > {"job-1"}
    with pytest.raises(ValueError):
        io.append_run_log(log, path, run_id="../x")


def test_a_half_written_dataset_is_written_anew(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="half-"), "table")
    os.makedirs(os.path.join(path, "split=train"))
    src = spark.createDataFrame([("1", "t", 0, "negative", s) for s in ("train", "validation", "test")], "id string, text string, label long, label_text string, split string")
    assert io.ingest_or_reuse(spark, path, lambda: src).count() == 3


def test_certain_errors_count_in_the_loss(spark):
    rows = [(0, 0, [0.0, 1.0]), (1, 1, [0.5, 0.5]), (2, 1, [1.0, 0.0]), (3, 5, [0.5, 0.5]), (4, None, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "pos long, label int, probs array<double>")
    r = evaluate.batched_log_loss(df, batch_size=2).first()
    first, second = (100 + math.log(2)) / 2, 100
    assert r.row_mean_loss == pytest.approx((200 + math.log(2)) / 3) and r.loss == pytest.approx((first + second) / 2)
