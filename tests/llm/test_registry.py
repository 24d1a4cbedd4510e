import re

import __spark_entry__ as entry


def test_one_query_for_every_operator_and_the_pipeline():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert {"op4_warc", "op5_topk", "op10_mixing", "op12_suffix", "op13_infill"} <= set(entry.oracle_sql())
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values()) and set(entry.oracle_sql()) <= set(entry.queries())
