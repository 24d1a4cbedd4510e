import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from revscope.llm import infill

SCHEMA = "doc_id long, text string, n int, form string, output string"
TEXTS = [None, "", "\n", "one line", "a\nb\n", "a\n\n\nb", "ünï\n𝒳 code points\n終", "has <P> inside\nb", "ends <S\nb\n<S", "x" * 50_000 + "\n" + "y\n" * 40_000, "a\nb\n"]


def brute(text, doc_id):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h4 % 100 < 50 else "psm", len(p), len(m), out


@pytest.mark.parametrize("n", [0, 1, 2, 5, 17, 400, 5000])
def test_seek_reaches_every_rank_with_both_widths(n):
    rng = random.Random(n)
    widths = [rng.randint(1, 30) for _ in range(n)]
    units = infill.SkipList(widths)
    for rank in range(n + 1):
        assert units.seek(rank) == (rank, sum(widths[:rank]))
    assert units.seek(n + 5) == (n, sum(widths))
    assert all(sum(u) == n and sum(p) == sum(widths) for u, p, _ in units.lanes)


def test_search_is_logarithmic():
    units = infill.SkipList([1] * 100_000)
    sizes = [len(u) for u, _, _ in units.lanes]
    assert sizes[-1] <= 8 and all(b < 0.4 * a for a, b in zip(sizes, sizes[1:]) if a > 1000)


def test_transform_and_restore_against_plain_slicing(spark):
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(TEXTS * 9)] + [(None, "a\nb\nc", None, None, None), (4, TEXTS[4], 1, "x", "y")]
    got = infill.transform(spark.createDataFrame(rows, SCHEMA)).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted([(i, *brute(t, i), t or "") for i, t, *_ in rows], key=key)
    assert sorted(map(tuple, got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_rates(spark):
    assert infill.transform(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(i, "a\nb\nc", 1, "x", "y") for i in range(200)], SCHEMA)
    assert {r.form for r in infill.transform(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in infill.transform(docs, spm=0).collect()} == {"psm"}


def test_query_equals_sql(spark):
    got = infill.op13_infill(spark, "/root/testdata/sf0.001").toPandas()
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = c.execute(infill.ORACLE_SQL).df()
    assert len(got) == len(want)
    a, b = (d.sort_values("doc_id").reset_index(drop=True) for d in (got, want))
    for col in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"):
        assert a[col].fillna(-1).tolist() == b[col].fillna(-1).tolist(), col
