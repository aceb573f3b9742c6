import hashlib
import random
import re

from echoframe.llm import decontamination as d
from hypothesis import given, settings
from hypothesis import strategies as st

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return [] if text is None else WORD.findall(text.encode().lower())


def _brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w = _words(text)
        hit, found = set(), set()
        for item_id, t in items:
            x = _words(t)
            m = min(window, len(x))
            patterns = {tuple(x[k : k + m]) for k in range(len(x) - m + 1)} if m else set()
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in patterns:
                    hit.update(range(k, k + m))
                    found.add(item_id)
        names = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(found)))
    return sorted(out, key=str)


def _fixture():
    rng = random.Random(4)
    vocabulary = ["w%d" % k for k in range(9)] + ["Été", "ÉTÉ", "a-b"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 25]) if k % 3 else 12)) for k in range(2, 40, 2)]
    items = [x for x in items if len(_words(x[1])) > 4] + [(900, None), (901, "!!"), (902, items[0][1])]
    docs = [(k, text(rng.randint(0, 60))) for k in range(40)]
    docs += [(100 + k, text(5) + ", " + t.upper() + "! " + text(4)) for k, t in items if t]
    return [*docs, (300, None), (301, ""), (302, items[0][1]), (302, items[0][1]), (None, items[1][1])], items


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_matches_brute_force(spark):
    docs, items = _fixture()
    a = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_words int")
    want = _brute(docs, items)
    assert sum(x[5] for x in want) > 10
    assert _rows(d.contamination(a, b)) == want
    assert _rows(d.contamination(a, b, block_bytes=400)) == want
    clean = sorted((x[0] for x in want if not x[5]), key=str)
    for size in (64 << 20, 4000):
        kept = d.remove_contaminated(a, b, block_bytes=size)
        assert kept.columns == a.columns and sorted((r.doc_id for r in kept.collect()), key=str) == clean


def test_long_texts_and_compiled_size():
    """A compiled block stays near the stated bytes for a byte of text; a text of 200,000 words is searched whole."""
    import pickle

    rng = random.Random(7)
    items = [(k, " ".join("w%d" % rng.randrange(5000) for _ in range(800))) for k in range(60)]
    block = d.Block(items, 10)
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(block)) < d._EACH * size
    words = ["v%d" % k for k in range(200_000)]
    words[150_000:150_010] = items[3][1].split()[100:110]
    assert [x for s in block.searches for x in s.search(d.Words(" ".join(words)))] == [(150_000, 3)]


def test_tables(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = _brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert _rows(d.contamination(docs, items)) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=6), max_size=6), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30), st.integers(1, 5))
def test_search_misses_nothing(items, words, window):
    searches = d.compile_items([(k, b" ".join(x).decode()) for k, x in enumerate(items)], window)
    found = [(s.m, start, i) for s in searches for start, i in s.search(d.Words(b" ".join(words).decode()))]
    got = set(found)
    assert len(got) == len(found)
    want = set()
    for i, x in enumerate(items):
        m = min(window, len(x))
        for p in {tuple(x[k : k + m]) for k in range(len(x) - m + 1)}:
            want |= {(m, k, i) for k in range(len(words) - m + 1) if tuple(words[k : k + m]) == p}
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert _rows(d.contamination(docs, none)) == [(1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert d.contamination(docs.limit(0), none).count() == 0
