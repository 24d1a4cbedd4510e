"""Written tables that no later step reads are removed, and large shuffles are cut into slices."""

import os

import pytest
from pyspark.sql import functions as F

from revscope.llm import mixing, neardup, passages, suffix
from revscope.llm.common import scratch, stored
from revscope.session import ensure_checkpoint_dir

WORDS = [f"w{i:03d}" for i in range(400)]


@pytest.fixture()
def docs(spark):
    shared = " ".join(WORDS[300:340])
    texts = [" ".join(WORDS[7 * i:7 * i + 60]) + (f"\n{shared}" if i % 3 == 0 else "") for i in range(30)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate([*texts, texts[0], None, ""])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def _tables(spark) -> set[str]:
    there = ensure_checkpoint_dir(spark).removeprefix("file:")
    return set(os.listdir(there)) if os.path.isdir(there) else set()


def test_only_kept_tables_outlive_their_block(spark):
    before = _tables(spark)
    with scratch() as keep:
        with scratch() as inner:
            a, b = inner(stored(spark.range(3), "inner-kept")), stored(spark.range(4), "inner-gone")
            assert b.count() == 4
        c = keep(stored(a.union(a), "kept"))
        assert _tables(spark) - before == {os.path.basename(a.stored_path), os.path.basename(c.stored_path)}
    assert _tables(spark) - before == {os.path.basename(c.stored_path)} and c.count() == 6


def test_failed_block_leaves_no_tables(spark):
    before = _tables(spark)
    with pytest.raises(ValueError), scratch():
        stored(spark.range(3), "lost")
        raise ValueError
    assert _tables(spark) == before


@pytest.mark.parametrize(("step", "name"), [(neardup.deduplicated, "least"), (passages.without_repeats, "spans"), (mixing.mixed_documents, "taken"), (suffix.without_repeats, "spans")])
def test_step_leaves_one_table(spark, docs, step, name):
    before = _tables(spark)
    out = step(docs)
    left = {t.rsplit("-", 1)[0] for t in _tables(spark) - before}
    assert left == {name}
    assert out.count() > 0  # what is left is all the result reads


def test_slices_give_what_one_pass_gives(spark, docs, monkeypatch):
    rows = lambda: sorted(map(tuple, suffix.without_repeats(docs).select("doc_id", "n_bytes", suffix.removed_bytes(F.col("spans")), F.sha2("kept", 256)).collect()))
    sliced = rows()
    monkeypatch.setattr(suffix, "PLACE_SLICES", 1)
    monkeypatch.setattr(suffix, "TEXT_SLICES", 1)
    assert sliced == rows() and any(r[2] for r in sliced)
