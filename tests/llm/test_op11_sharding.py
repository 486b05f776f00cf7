import random
import zlib

import pytest

from tickerlake import session
from tickerlake.llm import op11_sharding as op

SCHEMA = "doc_id long, text string, slot string, shard int, extra map<string, int>, mark array<string>"


def sharded(spark, rows, **settings):
    path = session.work_dir(spark, "test-shards")
    df = spark.createDataFrame(rows, SCHEMA)
    op.write_shards(df, path, **settings)
    return op.read_shards(spark, path, df.schema)


def table(n):
    rng = random.Random(5)
    return [(i, " ".join(rng.choice("abcd é") for _ in range(rng.choice([0, 3, 200]))), "x", i, {"k": i}, ["m"]) for i in range(n)]


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 2000])
def test_law_and_whole_rows(spark, bucket_bytes):
    odd = [(None, None, None, None, None, None), (None, "", "s", 1, {}, [None]), (7, "x" * 500_000, "long", 1, None, None), (7, "same", "a", 1, None, []), (7, "same", "b", 1, None, [])]
    rows = table(203) + odd + [(8, "again", "a", 1, {"a": 1}, ["b"])] * 300
    got = sharded(spark, rows, bucket_bytes=bucket_bytes).collect()
    assert sorted((tuple(r.row) for r in got), key=str) == sorted(rows, key=str)
    counts = [sum(r.shard == k for r in got) for k in range(8)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))


def test_order_follows_from_content_and_seed(spark):
    rows = table(400)
    order = lambda shuffled, **s: [r.row.doc_id for r in sharded(spark, shuffled, bucket_bytes=20_000, **s).orderBy("shard", "slot").collect()]
    first = order(rows)
    assert first == order(random.Random(1).sample(rows, len(rows)))
    assert first != order(rows, seed=3) and first != sorted(first)
    # a uniform order: neighbours in the table end up a third of the table apart
    place = {d: i for i, d in enumerate(first)}
    apart = [abs(place[i] - place[i + 1]) for i in range(399)]
    assert 110 < sum(apart) / len(apart) < 156
    assert sum(place[i] < place[399 - i] for i in range(200)) in range(75, 126)


def test_few_and_none(spark):
    assert sharded(spark, []).collect() == []
    got = sharded(spark, table(3), shards=5).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0), (2, 0)]


def test_described(spark):
    rows = [(1, None, "x", 1, None, None), (2, "aé", "x", 1, None, None)]
    got = {r.doc_id: r for r in op.described(sharded(spark, rows)).collect()}
    assert [(got[i].size, got[i].text_crc32, got[i].law, got[i].grown_shard) for i in (1, 2)] == [(1, 0, "rows", None), (4, zlib.crc32("aé".encode()), "rows", None)]
