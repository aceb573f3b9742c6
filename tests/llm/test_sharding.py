import hashlib

from echoframe.llm.sharding import assign_shards, write_shards


def _brute(rows, limit):
    """A directory that doubles and splits one bucket at a time."""
    bits = [(format(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), "060b"), i, len((t or "").encode())) for i, t in rows]
    done, stack = [], [("", bits)]
    while stack:
        prefix, bucket = stack.pop()
        size = sum(b for _, _, b in bucket)
        if not bucket:
            continue
        if size <= limit or len({h for h, _, _ in bucket}) == 1:
            done += [(i, b, len(prefix), prefix, size) for _, i, b in bucket]
        else:
            stack += [(prefix + x, [r for r in bucket if r[0][len(prefix)] == x]) for x in "01"]
    return sorted(done, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_matches_brute_force(spark, tmp_path):
    rows = [(i, "x" * (i * 7 % 90) + "é") for i in range(400)] + [(9, "again" * 9), (9, "again" * 9), (1000, "y" * 5000), (1001, None), (None, "z" * 30), (None, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, depth int")
    for limit, step in ((300, 8), (300, 1), (100000, 8), (1, 3)):
        assert _rows(assign_shards(docs, limit_bytes=limit, step=step)) == _brute(rows, limit)
    write_shards(docs, f"{tmp_path}/out", limit_bytes=2000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(rows) and back.select("shard").distinct().count() == len({r[3] for r in _brute(rows, 2000)})


def test_empty_table(spark):
    assert assign_shards(spark.createDataFrame([], "doc_id long, text string"), limit_bytes=10).count() == 0
