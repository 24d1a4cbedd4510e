import base64
import hashlib

from revscope.llm import warc
from revscope.session import scratch_path

SCHEMA = "page_id long, url string, html string, digest string, row_key string, last int"


def expected(rows, least=0):
    out, first = [], {}
    for page, _, html in sorted(((r[0] is None, r[0] or 0), r[1], r[2] or "") for r in rows):
        if len(html.encode()) >= least:
            first.setdefault(html, page[1])
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), first.get(html or "")))
    return out


def run(spark, rows, **options):
    path = scratch_path(spark, "t")
    warc.write_archive(spark.createDataFrame(rows, SCHEMA), path, **options)
    records = warc.read_records(spark, path)
    assert records.filter("NOT intact").count() == 0
    return path, warc.resolve_revisits(records).collect()


def test_round_trip_with_chunks_and_hard_payloads(spark):
    hard = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nx\n\r\n\r\n"
    bodies = ["<p>é𝄞</p>", None, "", "\n", "\r\n\r\n", hard, "long é\n" * 4000, "z" * 5000, hard, "long é\n" * 4000, "<p>é𝄞</p>"]
    rows = [(10 + i, f"http://x/{i}\r\nEvil: 1", b, "d", "k", 1) for i, b in enumerate(bodies)] + [(None, None, "only", None, None, None)]
    for chunk in (7, 100, 1 << 18):
        _, got = run(spark, rows, chunk_chars=chunk)
        got = {r.page_id: r for r in got}
        assert len(got) == len(rows)
        for page, size, digest, response in expected(rows):
            r = got[page]
            assert (r.payload_bytes, r.payload_digest) == (size, digest)
            if page is None or response == page:
                assert (r.record_type, r.refers_to) == ("response", None)
            else:
                assert (r.record_type, r.refers_to) == ("revisit", response)


def test_repeated_rows_elect_one_response(spark):
    _, got = run(spark, [(1, "u", "same", None, None, None)] * 3)
    assert sorted((r.record_type, r.refers_to) for r in got) == sorted([("response", None), ("revisit", 1), ("revisit", 1)], key=str)


def test_small_payloads_stay_responses(spark):
    _, got = run(spark, [(1, "u", "ab", None, None, None), (2, "u", "ab", None, None, None)], min_revisit_bytes=3)
    assert {r.record_type for r in got} == {"response"}


def test_archives_are_warc_text(spark):
    path, _ = run(spark, [(1, "u", "x" * 25, None, None, None)], chunk_chars=10)
    text = "\n".join(r.value for r in spark.read.option("lineSep", "\n").text(path).collect()) + "\n"
    assert text.count("WARC/1.1\r\n") == 3 and text.count("WARC-Type: continuation\r\n") == 2
    assert "WARC-Segment-Total-Length: 25\r\n" in text and text.endswith("\r\n\r\n")


def test_empty_table(spark):
    _, got = run(spark, [])
    assert got == []
