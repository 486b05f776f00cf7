import base64
import hashlib
import re

import pytest

from tickerlake import session
from tickerlake.llm import op3_warc as op

SCHEMA = "page_id long, url string, html string, key string, payload int"
ROWS = [
    (1, "http://a/", "same", "x", 1), (2, "http://b/", "same", "x", 1), (5, None, "same", "x", 1), (5, None, "same", "x", 1), (6, "http://c/\r\nX: y", None, "x", 1), (7, "u", "", "x", 1),
    (8, "u", "été\r\n\r\nWARC/1.1 \x00 日本" * 3, "x", 1), (9, "u", "long " * 100_000, "x", 1), (None, "n", "same", "x", 1), (None, "n", "only lost", "x", 1),
]


def expected(rows, least=0):
    best = {}
    for i, _, html, *_ in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    out = []
    for i, _, html, *_ in rows:
        body = (html or "").encode()
        own = i is not None and i == best[html or ""] or i is None and best[html or ""] == -1 or len(body) < least
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else best[html or ""], body))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    path = session.work_dir(spark, "warc-test")
    op.write_archive(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path, least)
    got = op.read_archive(spark, path)
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got.collect()]
    assert sorted(rows, key=str) == expected(ROWS, least)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in ROWS})


def test_exported_files_parse_by_length(spark):
    path = session.work_dir(spark, "warc-test")
    op.write_archive(spark.createDataFrame(ROWS, SCHEMA), path)
    op.export(op.read_archive(spark, path).coalesce(1), f"{path}/files")
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(f"{path}/files").where("path like '%part-%'").collect())
    seen = []
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        seen.append((re.search(rb"WARC-Type: (\w+)", head)[1].decode(), rest[:length]))
        assert rest[length : length + 4] == b"\r\n\r\n"
        data = rest[length + 4 :]
    assert sorted(seen) == sorted((r[3], r[5] if r[3] == "response" else b"") for r in expected(ROWS))


def test_empty_and_damaged(spark):
    path = session.work_dir(spark, "warc-test")
    op.write_archive(spark.createDataFrame([], SCHEMA), path)
    assert op.read_archive(spark, path).collect() == []
    path = session.work_dir(spark, "warc-test")
    op.write_archive(spark.createDataFrame(ROWS[:2], SCHEMA), path)
    stored = spark.read.parquet(f"{path}/payloads")
    stored.selectExpr("key", "cast('other' as binary) payload").write.parquet(f"{path}/changed/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}/changed/records")
    with pytest.raises(Exception, match="damaged record"):
        op.read_archive(spark, f"{path}/changed").collect()
