import random

import numpy as np
import pytest
from echoframe.llm import jaccard_join as j
from echoframe.llm.components import connected_components
from echoframe.llm.store import Workspace
from hypothesis import given, settings
from hypothesis import strategies as st


def _set(text, words=5):
    w = ("" if text is None else text).encode().lower().split()
    n = min(words, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def _components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _brute(rows):
    sets = [(i, _set(t)) for i, t in rows]
    holders = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    links = set()
    for k, (_, s) in enumerate(sets):
        for other in {o for x in s for o in holders[x] if o > k}:
            both = len(s & sets[other][1])
            if 100 * both >= 80 * (len(s) + len(sets[other][1]) - both):
                links.add((k, other))
    of = _components(range(len(rows)), links)
    least = {}
    for k, c in of.items():
        least[c] = min(least.get(c, sets[k][0]), sets[k][0])
    return sorted((sets[k][0], len(sets[k][1]), least[c]) for k, c in of.items())


def _rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def _corpus(seed=7):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    passage = " ".join(word() for _ in range(25))
    rows, i = [], 0
    for size in (3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 20, 33, 60, 120, 300):
        base = [word() for _ in range(size)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, max(1, size // 60)])):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [word()], [copy[k], word()]])
                if not copy:
                    copy = [word()]
            rows.append((i, " ".join(copy)))
            i += 1
    for _ in range(60):
        own = [word() for _ in range(rng.choice([10, 40, 80]))]
        rows.append((i, " ".join(own[:20]) + " " + passage + " " + " ".join(own[20:])))
        i += 1
    return rows


def test_matches_brute_force(spark):
    rows = _corpus() + [(9000, None), (9001, ""), (9002, " \t"), (9003, "One TWO"), (9004, "one two"), (9005, "é É"), (9006, "x" * 50000), (9007, " ".join(map(str, range(30000)))), (9008, " ".join(map(str, range(30100))))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, cls int").repartition(4)
    want = _brute(rows)
    assert len({c for _, _, c in want}) < len(rows) - 50
    assert _rows(j.group_documents(df, range_bytes=20000, flush=3000)) == want


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert _rows(j.group_documents(docs)) == _brute([(r.doc_id, r.text) for r in docs.collect()])


def test_crowded_groups_of_near_copies_lose_no_link(spark):
    """A chain: each text is similar to its neighbours only, and all share most signatures' words."""
    rng = random.Random(1)
    words = ["w%d" % k for k in range(200)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(words)))
        if i % 2:
            k = rng.randrange(len(words))
            words[k] = f"n{i}"
    got = _rows(j.group_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == _brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "q r s")]
    got = j.group_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got if r.n_shingles == 2) == [("1", 1), ("1", 1), ("2", 1), ("None", 1)]
    assert [r.component_id for r in got if r.n_shingles == 1] == [None]
    assert {r.n_copies for r in got if r.n_shingles == 2} == {4}
    assert j.group_documents(spark.createDataFrame([], "doc_id long, text string, n int")).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 400), st.floats(0, 0.15), st.floats(0, 0.15), st.integers(0, 2**32))
def test_similar_sets_share_the_promised_signatures(size, gone, more, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    b = np.unique(np.concatenate([a[rng.random(len(a)) >= gone], rng.integers(0, 2**64, int(more * size), dtype=np.uint64)]))
    m = j.Measure(80)
    if not len(b) or not m.linked(a, b) or np.array_equal(a, b):
        return
    sa, sb = list(j.signatures(a, m)), list(j.signatures(b, m))
    shared = sum(len(np.intersect1d(x, y)) for p, _, x in sa for q, _, y in sb if p == q)
    assert shared >= 1
    best = max((len(np.intersect1d(x, y)), least) for p, least, x in sa for q, _, y in sb if p == q)
    assert best[0] >= 1
    for p, least, x in sa:
        for q, _, y in sb:
            if p == q == max(m.band(len(a)), m.band(len(b))):
                assert len(np.intersect1d(x, y)) >= min(least, 1 if least == 1 else least)
    bits = min(m.sketch_bits(len(a)), m.sketch_bits(len(b))) // 8
    fold = lambda s: j._fold(j.sketch(s, m.sketch_bits(len(s))), bits)
    assert int(np.bitwise_count(fold(a) ^ fold(b)).sum()) <= m.difference(len(a) + len(b))


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 400)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t")).collect()}
    want = _components({x for e in links for x in e}, links)
    assert got == {k: v for k, v in want.items() if k in got}
    assert got.keys() == {x for a, b in links if a != b for x in (a, b)}


def test_percent_is_checked():
    with pytest.raises(ValueError):
        j.Measure(10)


def test_small_sets_share_a_pair_of_parts():
    """Subsets of two second-level parts: sets that differ in k elements or fewer agree in both parts of one."""
    m = j.Measure(80)
    assert [m.parts(b)[2] for b in range(12)].count(2) >= 3
    for band in range(12):
        parts, k, size = m.parts(band)
        if size == 2:
            s = np.unique(np.random.default_rng(band).integers(0, 2**64, m.edges[band], dtype=np.uint64))
            keys = [x for b, _, x in j.signatures(s, m) if b == band]
            assert parts == k + 2 and len(keys[0]) <= parts * (parts - 1) // 2


def test_keeps_one_row_of_each_group_with_any_column_names(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "other words are here now"), (4, None), (4, None), (5, ""), (None, "a b c d e f"), (None, "q r s"), (6, "x y z"), (6, "k l m n")]
    df = spark.createDataFrame([(*r, "d", "e") for r in rows], "doc_id long, text string, `_digest` string, `row` string")
    got = sorted(((str(r.doc_id), str(r.text), r["_digest"], r["row"]) for r in j.keep_one_of_each_group(df).collect()))
    want = [(1, "a b c d e f"), (3, "other words are here now"), (4, None), (5, ""), (None, "a b c d e f"), (None, "q r s"), (6, "x y z"), (6, "k l m n")]
    assert got == sorted((str(i), str(t), "d", "e") for i, t in want)
    assert sorted(map(tuple, j.keep_one_of_each_group(df, most_broadcast=-1).collect()), key=str) == sorted(map(tuple, j.keep_one_of_each_group(df).collect()), key=str)


def test_a_family_of_a_third_of_all_rows(spark):
    """Members beyond those that a range needs go by salt; no link is lost."""
    rng = random.Random(6)
    base = ["w%d" % rng.randrange(900) for _ in range(60)]
    rows = []
    for i in range(600):
        words = list(base) if i % 3 == 0 else ["v%d" % rng.randrange(10**6) for _ in range(40)]
        if i % 3 == 0:
            words[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = _rows(j.group_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), flush=4000, range_bytes=20000))
    assert got == _brute(rows)
