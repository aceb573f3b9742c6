import hashlib
import random

from echoframe.llm.line_dedup import dedup_lines

PRIME = (1 << 31) - 1


def _chunks(text, window=2, long_words=50):
    lines = text.split("\n")
    g = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    n = [len(x.encode().split()) for x in lines]
    r = [sum((g[i - b] if i >= b else 0) * 31**b for b in range(window)) % PRIME for i in range(len(lines))]
    out, now = [], []
    for i, line in enumerate(lines):
        now.append(line)
        peak = 0 < i < len(lines) - 1 and r[i] > r[i - 1] and r[i] >= r[i + 1]
        if i == len(lines) - 1 or peak or n[i] >= long_words or n[i + 1] >= long_words:
            out.append(now)
            now = []
    return out


def _brute(rows):
    """(doc_id, text, chunks, passages, lines removed), with whole strings as keys."""
    first, pairs, out = {}, {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        if text is None:
            out.append((i, None, 0, 0, 0))
            continue
        lines = text.split("\n")
        words = [len(x.encode().split()) for x in lines]
        gone, chunks, passages, at = set(), 0, 0, 0
        for c in _chunks(text):
            here = range(at, at + len(c))
            at += len(c)
            filled = sum(words[k] > 0 for k in here) >= 2 or sum(words[k] for k in here) >= 50
            if filled and first.setdefault("\n".join(c), (i, here[0])) != (i, here[0]):
                chunks += 1
                gone.update(here)
        k = 1
        while k < len(lines):
            start = k
            while k < len(lines) and pairs.setdefault((lines[k - 1], lines[k]), (i, k)) != (i, k):
                k += 1
            if k > start and sum(words[start - 1 : k]) >= 50:
                passages += 1
                gone.update(range(start - 1, k))
            k += k == start
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), chunks, passages, len(gone)))
    return sorted(out, key=str)


def _rows(df):
    return sorted(((r.doc_id, r.text, r.removed_chunks, r.removed_passages, r.removed_lines) for r in df.collect()), key=str)


def _corpus():
    rng = random.Random(9)
    line = lambda n=6: " ".join("w%d" % rng.randrange(500) for _ in range(n))
    shared = [line() for _ in range(12)]
    passage, short = line(60), [line(14) for _ in range(4)]
    rows = []
    for i in range(50):
        own = [line() for _ in range(rng.randint(0, 9))]
        if i % 3 == 0:
            k = rng.randint(0, len(own))
            own[k:k] = shared[: rng.choice([6, 12])]
        if i % 4 == 0:
            own.insert(rng.randint(0, len(own)), passage)
        if i % 5 == 0:
            k = rng.randint(0, len(own))
            own[k:k] = short
        rows.append((i, "\n".join(own)))
    return [*rows, (100, rows[3][1]), (101, rows[3][1]), (200, None), (201, ""), (206, "one line"), (202, "\n\n"), (203, "\n\n"), (204, "x y\n" * 40), (205, "é\nü " + "z" * 9000 + "\n"), (None, rows[5][1])]


def test_matches_brute_force(spark):
    rows = _corpus()
    want = _brute(rows)
    assert sum(x[2] for x in want) > 30
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, _hash int, removed_lines string").repartition(3)
    out = dedup_lines(df)
    assert _rows(out) == want
    assert out.columns == ["doc_id", "text", "_hash", "removed_chunks", "removed_passages", "removed_lines"]
    texts = dict(rows)
    for r in out.collect():
        if r.text is not None and r.removed_lines == 0:
            assert r.text == texts[r.doc_id]


def test_passages_of_short_lines_go_whole(spark):
    rng = random.Random(5)
    line = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    rows, passages = [], {}
    for trial in range(60):
        m = 2 + trial % 5
        passages[trial] = [line(52 // m + 1) for _ in range(m)]
        rows += [(trial * 10 + k, "\n".join([line(8) for _ in range(4)] + passages[trial] + [line(8) for _ in range(3)])) for k in range(3)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for trial, p in passages.items():
        assert got[trial * 10].text == texts[trial * 10]
        for k in (1, 2):
            assert got[trial * 10 + k].text.split("\n") == [x for x in texts[trial * 10 + k].split("\n") if x not in p]


def test_any_column_name_is_free(spark):
    names = ["id", "key", "row", "spans", "lines", "gone", "_text", "_digest", "l_id", "a", "kind", "text_"]
    rows = _corpus()[:20]
    df = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = dedup_lines(df)
    assert _rows(out) == _brute(rows)
    assert all([r[n] for n in names] == names for r in out.collect())


def test_without_broadcast(spark):
    rows = _corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _rows(dedup_lines(df, most_broadcast=0)) == _brute(rows)


def test_boundaries_resist_shifts():
    rng = random.Random(3)
    lines = [str(rng.random()) for _ in range(200)]
    a, b = _chunks("\n".join(lines)), _chunks("\n".join(["new", "lines", *lines]))
    assert {tuple(c) for c in a[2:]} <= {tuple(c) for c in b}


def test_tables_and_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert _rows(out) == _brute([(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b\nc d\ne f"), (1, "a b\nc d\ne f"), (1, "other")]
    assert _rows(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted([(*r, 0, 0, 0) for r in rows], key=str)
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
