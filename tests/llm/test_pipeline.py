import random

import corpus_pipeline
from revscope.llm import langid, mixing, neardup, packing, passages
from revscope.llm.common import stored
from revscope.session import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    rng = random.Random(8)
    words = {"en": "the of and to in is that for with on as at this by from".split() + [f"thing{i}" for i in range(400)],
             "de": "der die das und ist nicht mit auf ein von zu im".split() + [f"über{i}heit" for i in range(400)]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n)) + "."
    rows = []
    for i in range(160):
        lang = "de" if i % 4 == 0 else "en"
        rows.append([i, "\n".join(text(lang, rng.randint(30, 70)) for _ in range(rng.randint(1, 3))), lang, f"s{i % 3}"])
    passage = text("en", 60)
    for i in range(20, 40):
        rows[i][1] += "\n" + passage
    for i in range(60, 75):  # near copies
        t = rows[i][1].split(" ")
        t[len(t) // 2] = "changed"
        rows.append([200 + i, " ".join(t), rows[i][2], "s1"])
    rows += [[400, rows[5][1], "en", "s2"], [401, None, "en", "s0"], [402, "", None, "s0"], [403, "123 456 !!!", "en", None], [404, text("en", 50), None, None]]
    return spark.createDataFrame([(a, b, c, d, len(b or "")) for a, b, c, d in rows], SCHEMA)


def test_stages_and_run(spark):
    sf_dir = scratch_path(spark, "corpus")
    corpus(spark).write.parquet(f"{sf_dir}/documents.parquet")
    docs = source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "passages", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == source.columns
    # texts without letters go, all others stay
    assert ids(seen["language"]) == [i for i in ids(source) if i not in (401, 402, 403)]
    # one document of each class of the brute force stays
    classes = {r.id: r.class_id for r in neardup.classes(seen["language"]).collect()}
    assert ids(seen["near_duplicates"]) == sorted(set(classes.values()))
    assert not {260, 274, 400} & set(ids(seen["near_duplicates"]))
    # the passage stays with its first document; texts that hold none are untouched
    before = {r.doc_id: r for r in seen["near_duplicates"].collect()}
    after = {r.doc_id: r for r in seen["passages"].collect()}
    assert set(after) == set(before)
    changed = {i for i in after if after[i].text != before[i].text}
    assert changed == set(range(21, 40)) and all(after[i].n_chars == len(after[i].text) for i in after)
    # documents come as often as the mix takes them
    copies = {r.doc_id: r.copies for r in mixing.mix(seen["passages"]).collect()}
    assert ids(seen["mixing"]) == sorted(i for i, n in copies.items() for _ in range(n))
    # every id of every copy is packed
    tokens = {r.doc_id: r.doc_tokens for r in packing.tokenised(seen["passages"], packing.default_vocabulary(), 2048, 1).collect()}
    packed = seen["packing"].groupBy("doc_id").sum("length").collect()
    assert {r.doc_id: r["sum(length)"] for r in packed} == {i: tokens[i] * n for i, n in copies.items() if n}
    # run() is the same from end to end
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, docs.collect()))


def test_clean_documents_of_the_testdata_pass_the_language_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, "/root/testdata/sf0.1")
    lost = docs.join(kept.select("doc_id"), "doc_id", "left_anti")
    letters = langid.letters()
    assert lost.count() <= 0.005 * docs.count()
    assert all(len(r.text) < 400 or sum(letters[ord(c)] for c in r.text) < 0.5 * len(r.text) for r in lost.limit(50).collect())


def test_empty_corpus(spark):
    sf_dir = scratch_path(spark, "empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf_dir}/documents.parquet")
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
    assert passages.passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).count() == 0
