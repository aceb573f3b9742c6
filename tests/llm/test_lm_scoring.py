import collections
import math
import zlib

import pytest
from echoframe.llm.lm_scoring import score_documents

WORDS = "the a of red fox runs over dog and then some other thing happens here".split()


def _docs(n=120):
    import random

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS[: 3 + i % 12]) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return rows + [(500, None), (501, ""), (502, "  \n\t "), (503, "The\x0bFOX runs"), (503, "The fox runs"), (504, "x" * 70000 + " fox"), (None, "the fox")]


def _tokens(text):
    raw = ("" if text is None else text).encode().lower().split()
    return [*raw, b"<end>"]


def _fold(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 10


def test_matches_brute_force(spark):
    rows = _docs()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {}
    for r in score_documents(df, chunk_bytes=600, range_bytes=200).collect():
        got.setdefault((r.doc_id, r.n_tokens), []).append(r)
    train = [(i, _tokens(t)) for i, t in rows if _fold(i) not in (None, 0)]
    c = collections.Counter(w for _, t in train for w in t)
    n, v = sum(c.values()), len(c)
    assert sum(map(len, got.values())) == len(rows)
    for i, text in rows:
        t = _tokens(text)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        r = min(got[i, len(t)], key=lambda r: abs(r.base_score - base))
        assert r.train_tokens == n and r.n_known == sum(c[w] > 0 for w in t)
        assert r.held_out == (_fold(i) in (None, 0))
        assert r.base_score == pytest.approx(base, abs=1e-6)


def test_mixture_matches_its_definition(spark):
    """The n-gram part against counts of plain tuples, with the learned weights read back by probing."""
    from echoframe.llm import lm_scoring as m

    rows = [r for r in _docs(60) if r[0] is not None]
    train = [_tokens(t) for i, t in rows if _fold(i) != 0]
    grams = [collections.Counter(), collections.Counter(), collections.Counter()]
    for t in train:
        padded = [b"<s>", b"<s>", *t]
        for k in range(2, len(padded)):
            for n in (1, 2, 3):
                grams[n - 1][tuple(padded[k - n + 1 : k + 1])] += 1
    n, v = sum(grams[0].values()), len(grams[0])
    fixed = m.learn_weights(m.np.array([[0, 1.0, 2.0, 1.0]]))
    seen, original = [], m.learn_weights
    m.learn_weights = lambda cells: seen.append(cells) or fixed
    try:
        got = {(r.doc_id, r.n_tokens): r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=900, range_bytes=300).collect()}
    finally:
        m.learn_weights = original
    held = [t for (i, x), t in zip(rows, (_tokens(x) for _, x in rows)) if _fold(i) == 1]
    assert seen[0][:, 1].sum() == sum(map(len, held))
    for i, text in rows:
        t, total = _tokens(text), 0.0
        padded = [b"<s>", b"<s>", *t]
        for k in range(2, len(padded)):
            a, b, w = padded[k - 2 : k + 1]
            x2 = len(train) if b == b"<s>" else grams[0][(b,)]
            x3 = len(train) if b == b"<s>" else grams[1][(a, b)]
            p1 = (grams[0][(w,)] + 0.1) / (n + 0.1 * (v + 1))
            f2 = grams[1][(b, w)] / x2 if x2 else 0
            f3 = grams[2][(a, b, w)] / x3 if x3 else 0
            bucket = min(int(math.log2(x3 + 1)), 7) * 16 + min(int(math.log2(x2 + 1)), 15)
            l3, l2, l1 = fixed[bucket]
            total += math.log10(l3 * f3 + l2 * f2 + l1 * p1)
        assert got[i, len(t)].score == pytest.approx(total, abs=1e-6)


def test_weights_prefer_the_better_estimate():
    from echoframe.llm.lm_scoring import learn_weights, np

    w = learn_weights(np.array([[3, 1000.0, 50.0, 2.0], [7, 1000.0, 0.0, 0.1]]))
    assert w[3].argmax() == 0 and w[7].argmax() == 2
    assert np.allclose(w.sum(1), 1)


def test_beats_the_unigram_floor_on_unseen_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = score_documents(docs).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert r["sum(score)"] > r["sum(base_score)"]


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, score int, kind string")
    assert score_documents(empty).count() == 0
    df = spark.createDataFrame([(1, "a b", 3, "z")], "doc_id long, text string, score int, kind string")
    assert score_documents(df).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert score_documents(df).count() == 1
